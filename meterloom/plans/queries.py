"""The registered queries of the panel operators, and their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import aggregate as A
from ..operators import evaluate as E
from ..operators import fitting as FT
from ..operators import intervals as IV
from ..operators import models as M
from ..operators import panel as P
from ..operators import scoring as S
from ..operators import stats as X
from ..operators import waste as WS
from ..operators import windows as W
from ..storage import stored
from . import panels
from .panels import daily, hourly, injected, planted, table, test_span

Q, SQL = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


def r6(*cols: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in cols]


# ---------------------------------------------------------------- shared parts


def reference(d: DataFrame) -> DataFrame:
    return d.where("span <> 'test'")


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(daily panel, events, injected test rows with slot score s, flags). Events and flags are stored: what
    judges them reads them several times."""
    d = daily(spark, sf_dir)
    ev = stored(planted(d), "events")
    fl = stored(W.trailing_flags(S.slot_z(test_span(injected(d, ev)), reference(d), "slot")), "flags")
    return d, ev, fl, fl


def residual(d: DataFrame, ev: DataFrame) -> DataFrame:
    """(entity, idx, resid): injected test load minus the slot's train median."""
    p = S.slot_profile(d.where("span = 'train'"))
    return S.profile_residual(test_span(injected(d, ev)), p, out="resid").select("entity", "idx", "resid")


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, site, model, seed, v): mean discounts as a stand-in for a measure of models."""
    li = table(spark, sf_dir, "lineitem")
    k = (F.col("l_suppkey") % 25).cast("string")
    site = F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string"))
    return li.groupBy(
        F.concat(site, F.lit("_e"), k).alias("entity"), site.alias("site"), F.concat(F.lit("m"), (F.col("l_partkey") % 4).cast("string")).alias("model"), (F.col("l_orderkey") % 3).cast("int").alias("seed")
    ).agg(F.avg("l_discount").alias("v"))


MODELS = ["m0", "m1", "m2", "m3"]

_H = """h0 AS (SELECT event_type AS entity, date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS x FROM events GROUP BY 1, 2),
hb AS (SELECT min(ts) AS lo, max(ts) AS hi FROM h0),
hg AS (SELECT entity, g.ts FROM (SELECT DISTINCT entity FROM h0) e, (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM hb) g),
h AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS idx, ts, x FROM hg LEFT JOIN h0 USING (entity, ts))"""

_D = """d0 AS (SELECT o_orderpriority AS entity, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1, 2),
db AS (SELECT min(ts) AS lo, max(ts) AS hi FROM d0),
dg AS (SELECT entity, g.ts FROM (SELECT DISTINCT entity FROM d0) e, (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM db) g),
d1 AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS idx, ts, coalesce(x / 1000, 0) AS x, isodow(ts) - 1 AS slot,
  count(*) OVER (PARTITION BY entity) AS n FROM dg LEFT JOIN d0 USING (entity, ts)),
d2 AS (SELECT *, floor(n * 0.6::DOUBLE) AS a, floor(n * 0.75::DOUBLE) AS b FROM d1),
d AS (SELECT entity, idx, ts, x, slot, CASE WHEN idx < a THEN 'train' WHEN idx < b THEN 'val' ELSE 'test' END AS span,
  (idx - CASE WHEN idx < a THEN 0 WHEN idx < b THEN a ELSE b END)::BIGINT AS span_idx FROM d2)"""

_EV = _D + """,
sc AS (SELECT entity, round(stddev_pop(x), 3) AS sd FROM d WHERE span = 'train' GROUP BY 1),
ev AS (SELECT entity, k AS event_id, 180 + 60 * k AS "start", 180 + 60 * k + 4 + 6 * k AS "end", ['spike', 'drift', 'schedule'][k % 3 + 1] AS type,
  k // 2 + 1 AS severity, round((4 + 6 * k) * (k // 2 + 1) * sd, 6) AS true_kwh, (k // 2 + 1) * sd AS add FROM sc, range(6) AS r(k)),
t AS (SELECT d.entity, span_idx AS idx, ts, x + coalesce(add, 0) AS x, slot FROM d LEFT JOIN ev ON d.entity = ev.entity AND span_idx >= ev."start" AND span_idx < ev."end" WHERE span = 'test'),
ref AS (SELECT * FROM d WHERE span <> 'test')"""


def _mad(name: str, src: str, keys: str, x: str = "x") -> str:
    return f"""{name} AS (SELECT {keys}, any_value(m) AS med, 1.4826 * median(abs({x} - m)) AS mad, count(*) AS n
  FROM (SELECT *, median({x}) OVER (PARTITION BY {keys}) AS m FROM {src} WHERE {x} IS NOT NULL) GROUP BY {keys})"""


_Z = _EV + f""",
{_mad('pm', 'ref', 'entity')},
{_mad('sm', 'ref', 'entity, slot')},
z AS (SELECT t.*, (t.x - CASE WHEN sm.n >= 20 THEN sm.med ELSE pm.med END) / (CASE WHEN sm.n >= 20 THEN sm.mad ELSE pm.mad END + 1e-9) AS s
  FROM t JOIN pm ON t.entity = pm.entity LEFT JOIN sm ON t.entity = sm.entity AND t.slot = sm.slot)"""


def _flagger(src: str, past: str, frame: str, out: str = "fl") -> str:
    return f"""{out}0 AS (SELECT *, {past} AS p FROM {src}),
{out}1 AS (SELECT *, CASE WHEN count(p) OVER w >= 84 THEN median(p) OVER w END AS med FROM {out}0 WINDOW w AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN {frame})),
{out}2 AS (SELECT *, abs(p - med) AS dev FROM {out}1),
{out}3 AS (SELECT *, CASE WHEN count(dev) OVER w >= 84 THEN 1.4826 * median(dev) OVER w END AS mad FROM {out}2 WINDOW w AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN {frame})),
{out} AS (SELECT *, (s - med) / (mad + 1e-9) AS z, coalesce((s - med) / (mad + 1e-9) > 2.3263478740408408, false) AS flag FROM {out}3)"""


_LAG = "lag(s) OVER (PARTITION BY entity ORDER BY idx)"
_FL = _Z + ",\n" + _flagger("z", _LAG, "335 PRECEDING AND CURRENT ROW")


def _runs(src: str = "fl", out: str = "rn", gap: int = 1) -> str:
    return f"""{out}0 AS (SELECT entity, idx, coalesce(idx - lag(idx) OVER (PARTITION BY entity ORDER BY idx) > {gap}, true)::INT AS new FROM {src} WHERE flag),
{out}1 AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY idx) AS k FROM {out}0),
{out} AS (SELECT entity, min(idx) AS "start", max(idx) + 1 AS "end" FROM {out}1 GROUP BY entity, k)"""


_RN = _FL + ",\n" + _runs()
_RES = """,
prof AS (SELECT entity, slot, median(x) AS med FROM d WHERE span = 'train' GROUP BY 1, 2),
res AS (SELECT t.entity, t.idx, t.x - prof.med AS resid FROM t LEFT JOIN prof ON t.entity = prof.entity AND t.slot = prof.slot)"""
_DET = _RN + """,
ed AS (SELECT ev.entity, event_id, any_value(type) AS type, any_value(severity) AS severity, any_value(ev."start") AS "start", any_value(ev."end") AS "end", any_value(true_kwh) AS true_kwh,
  min(CASE WHEN flag THEN fl.idx END) AS hit, avg(flag::INT::DOUBLE) AS range_cov
  FROM ev JOIN fl ON fl.entity = ev.entity AND fl.idx >= ev."start" AND fl.idx < ev."end" GROUP BY 1, 2),
fe AS (SELECT fl.*, EXISTS (SELECT 1 FROM ev WHERE ev.entity = fl.entity AND fl.idx >= ev."start" AND fl.idx < ev."end") AS on_ FROM fl),
rd AS (SELECT rn.entity, rn."start", rn."end", avg(on_::INT::DOUBLE) AS overlap FROM rn JOIN fe ON fe.entity = rn.entity AND fe.idx >= rn."start" AND fe.idx < rn."end" GROUP BY 1, 2, 3)"""


# ---------------------------------------------------------------- panels and cleaning


@query
def panel_hourly_dense(spark, sf_dir):
    return hourly(spark, sf_dir).select("entity", "idx", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("hour"), "x")


SQL["panel_hourly_dense"] = f"WITH {_H} SELECT entity, idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS hour, x FROM h"


@query
def panel_daily(spark, sf_dir):
    return daily(spark, sf_dir).select("entity", "idx", "slot", "span", "span_idx", *r6("x"))


SQL["panel_daily"] = f"WITH {_D} SELECT entity, idx, slot::INT AS slot, span, span_idx, round(x, 6) AS x FROM d"


@query
def interpolate_limit(spark, sf_dir):
    h = hourly(spark, sf_dir)
    # a known pattern of gaps of 1 to 12 hours besides those that are there
    gappy = h.withColumn("x", F.when(F.col("idx") % 40 >= F.col("idx") / 40 % 12, F.col("x")))
    return P.interpolated(gappy).select("entity", "idx", *r6("x"))


SQL["interpolate_limit"] = f"""WITH {_H},
g AS (SELECT entity, idx, CASE WHEN idx % 40 >= (idx / 40.0::DOUBLE) % 12 THEN x END AS x FROM h),
k AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i0,
  first_value(x IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS i1 FROM g
  WINDOW b AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT entity, idx, round(CASE WHEN x IS NOT NULL THEN x WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (i1 - i0) * least(idx - i0, 6) END, 6) AS x FROM k"""


@query
def fill_mask(spark, sf_dir):
    return P.fill_mask(hourly(spark, sf_dir))


SQL["fill_mask"] = f"WITH {_H} SELECT entity, idx FROM h WHERE x IS NULL"


def _by_nation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return P.dense(P.resample(o.join(n, F.col("o_custkey") == F.col("c_custkey")), "n_name", "o_orderdate", "o_totalprice", "day", "sum", 2), "1 day")


@query
def completeness_topn(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("site"))
    q = P.quality(_by_nation(spark, sf_dir)).join(F.broadcast(dim), "entity", "left")
    return P.select_top(q, "site", 2, 0.01).select("site", "entity", F.col("rank").cast("int"), "n", *r6("completeness"), F.round("mean", 3).alias("mean"))


SQL["completeness_topn"] = """WITH d0 AS (SELECT n_name AS entity, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) AS x
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM d0),
g AS (SELECT entity, s.ts FROM (SELECT DISTINCT entity FROM d0) e, (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM b) s),
q AS (SELECT entity, count(*) AS n, avg((x IS NOT NULL)::INT::DOUBLE) AS completeness, avg(x) AS mean, stddev_samp(x) AS sd, max(x) AS top FROM g LEFT JOIN d0 USING (entity, ts) GROUP BY 1),
k AS (SELECT r_name AS site, q.*, row_number() OVER (PARTITION BY r_name ORDER BY completeness DESC, entity) AS rank
  FROM q LEFT JOIN nation ON n_name = entity LEFT JOIN region ON n_regionkey = r_regionkey
  WHERE completeness >= 0.01 AND sd > 0.05 * greatest(abs(mean), 1e-9) AND top > 0)
SELECT site, entity, rank::INT AS rank, n, round(completeness, 6) AS completeness, round(mean, 3) AS mean FROM k WHERE rank <= 2"""


@query
def eligible_entities(spark, sf_dir):
    return P.eligible(_by_nation(spark, sf_dir), rows=500, share=0.02)


SQL["eligible_entities"] = """WITH d0 AS (SELECT n_name AS entity, date_trunc('day', o_orderdate) AS ts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
b AS (SELECT datediff('day', min(ts), max(ts)) + 1 AS n FROM d0), k AS (SELECT entity, count(*) AS n_known FROM d0 GROUP BY 1)
SELECT entity, n::BIGINT AS n, n_known FROM k, b WHERE n >= 500 AND n_known >= 0.02 * n"""


@query
def wide_unpivot(spark, sf_dir):
    """A wide table (a column per event type) and back."""
    from ..sources.panels import long_from_wide

    h = hourly(spark, sf_dir)
    names = [r[0] for r in h.select("entity").distinct().orderBy("entity").collect()]  # the columns of a wide file
    return long_from_wide(h.withColumnRenamed("ts", "timestamp").groupBy("timestamp").pivot("entity", names).agg(F.max("x"))).groupBy("entity").agg(
        F.count("*").alias("n"), F.count("x").alias("n_known"), F.round(F.sum("x"), 3).alias("total")
    )


SQL["wide_unpivot"] = f"WITH {_H} SELECT entity, count(*) AS n, count(x) AS n_known, round(sum(x), 3) AS total FROM h GROUP BY 1"


@query
def local_hours(spark, sf_dir):
    zones = F.create_map(*[F.lit(v) for kv in zip(("click", "view", "purchase"), ("US/Eastern", "Europe/London", "Asia/Kolkata")) for v in kv])
    h = hourly(spark, sf_dir).withColumn("timezone", F.coalesce(F.element_at(zones, F.col("entity")), F.lit("UTC")))
    return P.local_hours(h).select("entity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("hour"), *r6("x"))


SQL["local_hours"] = f"""WITH {_H}, l AS (SELECT entity, timezone(CASE entity WHEN 'click' THEN 'US/Eastern' WHEN 'view' THEN 'Europe/London' WHEN 'purchase' THEN 'Asia/Kolkata' ELSE 'UTC' END, timezone('UTC', ts)) AS l, ts, x FROM h)
SELECT entity, strftime(l, '%Y-%m-%d %H:%M:%S') AS hour, round(x, 6) AS x FROM l QUALIFY row_number() OVER (PARTITION BY entity, l ORDER BY ts) = 1"""


@query
def calendar_features(spark, sf_dir):
    d = hourly(spark, sf_dir).withColumns(C.cyclic(F.col("ts"))).withColumn("how", C.hour_of_week(F.col("ts")))
    d = d.withColumns({"hour": C.hour_from_cyclic(F.col("hour_sin"), F.col("hour_cos")), "dow": C.weekday_from_cyclic(F.col("dow_sin"), F.col("dow_cos")), "proxy": C.climate_proxy(F.col("ts"), F.lit(40.0))})
    return d.select("entity", "idx", "how", "hour", "dow", *r6("hour_sin", "hour_cos", "dow_sin", "dow_cos", "proxy"))


_PROXY = "28.0 - 0.55 * 40.0 + 16.0 * sin((dayofyear(ts) + hour(ts) / 24.0::DOUBLE - 100) * (2 * pi() / 365.25)) + 0.15 * 16.0 * sin((hour(ts) - 5) * (2 * pi() / 24))"
SQL["calendar_features"] = f"""WITH {_H} SELECT entity, idx, ((isodow(ts) - 1) * 24 + hour(ts))::INT AS how, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS dow,
  round(sin(hour(ts) * (2 * pi() / 24)), 6) AS hour_sin, round(cos(hour(ts) * (2 * pi() / 24)), 6) AS hour_cos,
  round(sin((isodow(ts) - 1) * (2 * pi() / 7)), 6) AS dow_sin, round(cos((isodow(ts) - 1) * (2 * pi() / 7)), 6) AS dow_cos, round({_PROXY}, 6) AS proxy FROM h"""


@query
def scaled_features(spark, sf_dir):
    return P.scale(daily(spark, sf_dir), ["x"]).select("entity", "idx", *r6("z_x"))


SQL["scaled_features"] = f"""WITH {_D}, s AS (SELECT entity, avg(x) AS m, stddev_samp(x) AS sd FROM d WHERE span = 'train' GROUP BY 1)
SELECT d.entity, idx, round((x - m) / CASE WHEN sd = 0 THEN 1e-8 ELSE sd END, 6) AS z_x FROM d JOIN s ON d.entity = s.entity"""


@query
def split_from_end(spark, sf_dir):
    return P.split_from_end(daily(spark, sf_dir).drop("span")).groupBy("entity", "span").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


SQL["split_from_end"] = f"""WITH {_D}, c AS (SELECT entity, idx, count(*) OVER (PARTITION BY entity) AS n FROM d),
k AS (SELECT *, n - floor(n * 0.25::DOUBLE) AS b, n - floor(n * 0.25::DOUBLE) - floor(n * 0.15::DOUBLE) AS a FROM c)
SELECT entity, CASE WHEN idx < a THEN 'train' WHEN idx < b THEN 'val' ELSE 'test' END AS span, count(*) AS n, min(idx) AS first FROM k GROUP BY 1, 2"""


# ---------------------------------------------------------------- profiles and scores


@query
def slot_profile(spark, sf_dir):
    d = daily(spark, sf_dir)
    return S.slot_profile(d.where("span = 'train'")).select("entity", "slot", *r6("med"))


SQL["slot_profile"] = f"WITH {_D} SELECT entity, slot::INT AS slot, round(median(x), 6) AS med FROM d WHERE span = 'train' GROUP BY 1, 2"


@query
def slot_mad(spark, sf_dir):
    return S.median_mad(reference(daily(spark, sf_dir)), ["entity", "slot"]).select("entity", "slot", "n", *r6("med", "mad"))


SQL["slot_mad"] = f"WITH {_EV}, {_mad('sm', 'ref', 'entity, slot')} SELECT entity, slot::INT AS slot, n, round(med, 6) AS med, round(mad, 6) AS mad FROM sm"


@query
def profile_residuals(spark, sf_dir):
    d = daily(spark, sf_dir)
    tr = d.where("span = 'train'")
    sd = tr.groupBy("entity").agg(F.stddev_samp("x").alias("sd"))
    return S.profile_residual(d, S.slot_profile(tr), sd).select("entity", "idx", *r6("r"))


SQL["profile_residuals"] = f"""WITH {_D}, p AS (SELECT entity, slot, median(x) AS med FROM d WHERE span = 'train' GROUP BY 1, 2), s AS (SELECT entity, stddev_samp(x) AS sd FROM d WHERE span = 'train' GROUP BY 1)
SELECT d.entity, idx, round((x - med) / sd, 6) AS r FROM d LEFT JOIN p ON p.entity = d.entity AND p.slot = d.slot JOIN s ON s.entity = d.entity"""


@query
def slot_zscore(spark, sf_dir):
    return scored(spark, sf_dir)[2].select("entity", "idx", *r6("s"))


SQL["slot_zscore"] = f"WITH {_Z} SELECT entity, idx, round(s, 6) AS s FROM z"


@query
def global_zscore(spark, sf_dir):
    d = daily(spark, sf_dir)
    return S.slot_z(test_span(injected(d, planted(d))), reference(d), None).select("entity", "idx", *r6("s"))


SQL["global_zscore"] = f"WITH {_EV}, {_mad('pm', 'ref', 'entity')} SELECT t.entity, idx, round((x - med) / (mad + 1e-9), 6) AS s FROM t JOIN pm ON t.entity = pm.entity"


@query
def hod_zscore(spark, sf_dir):
    h = P.split(P.interpolated(hourly(spark, sf_dir)).withColumn("slot", C.hour_slot(F.col("ts"))))
    return S.slot_z(h.where("span = 'test'"), reference(h), "slot", least=12).select("entity", "idx", *r6("s"))


SQL["hod_zscore"] = f"""WITH {_H},
k AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i0,
  first_value(x IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS i1 FROM h
  WINDOW b AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT entity, idx, hour(ts) AS slot, count(*) OVER (PARTITION BY entity) AS n_,
  CASE WHEN x IS NOT NULL THEN x WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (i1 - i0) * least(idx - i0, 6) END AS x FROM k),
ref AS (SELECT * FROM i WHERE idx < floor(n_ * 0.75::DOUBLE)), t AS (SELECT * FROM i WHERE idx >= floor(n_ * 0.75::DOUBLE)),
{_mad('pm', 'ref', 'entity')},
{_mad('sm', 'ref', 'entity, slot')}
SELECT t.entity, t.idx, round((t.x - CASE WHEN sm.n >= 12 THEN sm.med ELSE pm.med END) / (CASE WHEN sm.n >= 12 THEN sm.mad ELSE pm.mad END + 1e-9), 6) AS s
FROM t JOIN pm ON t.entity = pm.entity LEFT JOIN sm ON t.entity = sm.entity AND t.slot = sm.slot"""


@query
def long_scale_z(spark, sf_dir):
    d = daily(spark, sf_dir)
    r = S.profile_residual(d, S.slot_profile(d.where("span = 'train'")), out="x")
    return S.long_z(test_span(r), reference(r)).select("entity", "idx", *r6("long"))


_LONG = """lq AS (SELECT entity, span <> 'test' AS is_ref, CASE WHEN span = 'test' THEN span_idx ELSE idx END AS idx, r FROM rr),
lw AS (SELECT *, CASE WHEN count(r) OVER w >= 24 THEN pow(avg(r) OVER w, 2) END AS x FROM lq WINDOW w AS (PARTITION BY entity, is_ref ORDER BY idx ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)),
lref AS (SELECT entity, x FROM lw WHERE is_ref)"""
SQL["long_scale_z"] = f"""WITH {_D}, p AS (SELECT entity, slot, median(x) AS med FROM d WHERE span = 'train' GROUP BY 1, 2),
rr AS (SELECT d.entity, idx, span, span_idx, x - med AS r FROM d LEFT JOIN p ON p.entity = d.entity AND p.slot = d.slot),
{_LONG}, {_mad('lm', 'lref', 'entity')}
SELECT lw.entity, idx, round((x - med) / (mad + 1e-9), 6) AS long FROM lw JOIN lm ON lw.entity = lm.entity WHERE NOT is_ref"""


@query
def towt_residuals(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("temp", C.climate_proxy(F.col("ts"), F.lit(40.0)))
    return S.towt_residual(d, F.col("span") == "train").select("entity", "idx", F.round("r", 4).alias("r"))


SQL["towt_residuals"] = f"""WITH {_D}, e AS (SELECT *, {_PROXY} AS t1 FROM d), f AS (SELECT *, t1 * t1 AS t2 FROM e),
m AS (SELECT entity, slot, avg(t1) AS a, avg(t2) AS b, avg(x) AS y FROM f WHERE span = 'train' GROUP BY 1, 2),
c AS (SELECT f.entity, idx, span, t1 - a AS a, t2 - b AS b, x - y AS v FROM f LEFT JOIN m ON m.entity = f.entity AND m.slot = f.slot),
s AS (SELECT entity, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * v) AS av, sum(b * v) AS bv FROM c WHERE span = 'train' GROUP BY 1)
SELECT c.entity, idx, round(v - (av * bb - bv * ab) / (aa * bb - ab * ab) * a - (bv * aa - av * ab) / (aa * bb - ab * ab) * b, 4) AS r FROM c JOIN s ON s.entity = c.entity"""


@query
def excursions(spark, sf_dir):
    d = daily(spark, sf_dir)
    return S.excursions(test_span(d), reference(d), "x").select("entity", *r6("over3", "over5"), "longest")


SQL["excursions"] = f"""WITH {_EV}, {_mad('pm', 'ref', 'entity')},
u AS (SELECT d.entity, span_idx AS idx, abs((x - med) / nullif(mad, 0)) AS z, coalesce(abs((x - med) / nullif(mad, 0)) > 3, false) AS flag FROM d JOIN pm ON pm.entity = d.entity WHERE span = 'test'), {_runs('u')},
l AS (SELECT entity, max("end" - "start") AS longest FROM rn GROUP BY 1)
SELECT u.entity, round(avg(coalesce(z > 3, false)::INT::DOUBLE), 6) AS over3, round(avg(coalesce(z > 5, false)::INT::DOUBLE), 6) AS over5, coalesce(any_value(longest), 0) AS longest FROM u LEFT JOIN l ON l.entity = u.entity GROUP BY 1"""


@query
def quantile_thresholds(spark, sf_dir):
    d = daily(spark, sf_dir)
    val, test = d.where("span = 'val'"), d.where("span = 'test'")
    a = S.quantile_threshold(val, "x").withColumnRenamed("level", "fixed_level")
    return a.join(S.adapted_threshold(val, test, "x"), "entity").select("entity", *r6("fixed_level", "level"))


SQL["quantile_thresholds"] = f"""WITH {_D}, v AS (SELECT * FROM d WHERE span = 'val'), u AS (SELECT * FROM d WHERE span = 'test'), {_mad('mv', 'v', 'entity')}, {_mad('mu', 'u', 'entity')},
q AS (SELECT entity, quantile_cont(x, 1 - 0.01::DOUBLE) AS lv FROM v GROUP BY 1)
SELECT q.entity, round(lv, 6) AS fixed_level, round(lv * mu.mad / (mv.mad + 1e-9), 6) AS level FROM q JOIN mv ON mv.entity = q.entity JOIN mu ON mu.entity = q.entity"""


@query
def outside_range(spark, sf_dir):
    d = daily(spark, sf_dir)
    return S.outside_range(d.where("span = 'test'"), d.where("span = 'train'"), "x").select("entity", *r6("share"))


SQL["outside_range"] = f"""WITH {_D}, r AS (SELECT entity, min(x) AS lo, max(x) AS hi FROM d WHERE span = 'train' GROUP BY 1)
SELECT d.entity, round(avg((NOT x BETWEEN lo AND hi)::INT::DOUBLE), 6) AS share FROM d JOIN r ON r.entity = d.entity WHERE span = 'test' GROUP BY 1"""


# ---------------------------------------------------------------- flaggers and runs


@query
def trailing_flags(spark, sf_dir):
    return scored(spark, sf_dir)[3].select("entity", "idx", *r6("med", "mad"), F.when(F.col("mad") > 0, F.round("z", 4)).alias("z"), "flag")


_SHOW = "SELECT entity, idx, round(med, 6) AS med, round(mad, 6) AS mad, CASE WHEN mad > 0 THEN round(z, 4) END AS z, flag FROM"
SQL["trailing_flags"] = f"WITH {_FL} {_SHOW} fl"


@query
def inclusive_flags(spark, sf_dir):
    return W.inclusive_flags(scored(spark, sf_dir)[2]).select("entity", "idx", *r6("med", "mad"), F.when(F.col("mad") > 0, F.round("z", 4)).alias("z"), "flag")


SQL["inclusive_flags"] = f"WITH {_Z},\n{_flagger('z', 's', '335 PRECEDING AND CURRENT ROW')} {_SHOW} fl"


@query
def centered_flags(spark, sf_dir):
    return W.centered_flags(scored(spark, sf_dir)[2]).select("entity", "idx", *r6("med", "mad"), F.when(F.col("mad") > 0, F.round("z", 4)).alias("z"), "flag")


SQL["centered_flags"] = f"""WITH {_Z},
{_flagger('z', 's', '168 PRECEDING AND 167 FOLLOWING')},
cf AS (SELECT entity, idx, s, coalesce(first_value(med IGNORE NULLS) OVER f, last_value(med IGNORE NULLS) OVER b) AS med, coalesce(first_value(mad IGNORE NULLS) OVER f, last_value(mad IGNORE NULLS) OVER b) AS mad FROM fl
  WINDOW b AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT entity, idx, round(med, 6) AS med, round(mad, 6) AS mad, CASE WHEN mad > 0 THEN round((s - med) / (mad + 1e-9), 4) END AS z, coalesce((s - med) / (mad + 1e-9) > 2.3263478740408408, false) AS flag FROM cf"""


@query
def flag_windows(spark, sf_dir):
    """Alarms under several flagger windows."""
    t, out = scored(spark, sf_dir)[2], None
    for n in (168, 336, 672):
        f = W.trailing_flags(t, window=n).groupBy("entity").agg(F.count(F.when(F.col("flag"), 1)).alias("n")).withColumn("window", F.lit(n))
        out = f if out is None else out.unionByName(f)
    return out


SQL["flag_windows"] = f"WITH {_Z},\n" + ",\n".join(_flagger("z", _LAG, f"{n - 1} PRECEDING AND CURRENT ROW", f"f{n}").replace(">= 84", f">= {n // 4}") for n in (168, 336, 672)) + " " + " UNION ALL ".join(f'SELECT entity, count(*) FILTER (flag) AS n, {n} AS "window" FROM f{n} GROUP BY 1' for n in (168, 336, 672))


@query
def alarm_runs(spark, sf_dir):
    """Flagship: dense panel, frozen slot profile, trailing flagger, alarm intervals."""
    return W.runs(scored(spark, sf_dir)[3])


SQL["alarm_runs"] = f'WITH {_RN} SELECT entity, "start", "end" FROM rn'


@query
def merged_runs(spark, sf_dir):
    return W.runs(scored(spark, sf_dir)[3], gap=6)


SQL["merged_runs"] = f'WITH {_FL}, {_runs("fl", "rn", 6)} SELECT entity, "start", "end" FROM rn'


@query
def bridged_flags(spark, sf_dir):
    return scored(spark, sf_dir)[3].withColumn("flag", W.bridged()).groupBy("entity").agg(F.count(F.when(F.col("flag"), 1)).alias("n"))


SQL["bridged_flags"] = f'WITH {_FL}, {_runs("fl", "rn", 6)} SELECT e.entity, coalesce(sum("end" - "start"), 0)::BIGINT AS n FROM (SELECT DISTINCT entity FROM fl) e LEFT JOIN rn ON rn.entity = e.entity GROUP BY 1'


@query
def long_runs(spark, sf_dir):
    return W.long_runs(W.runs(scored(spark, sf_dir)[3]), 3)


SQL["long_runs"] = f'WITH {_RN} SELECT entity, "start", "end" FROM rn WHERE "end" - "start" >= 3'


@query
def merged_intervals(spark, sf_dir):
    r = W.runs(scored(spark, sf_dir)[3]).withColumn("end", F.col("end") + F.col("start") % 15)
    return W.merged_intervals(r)


SQL["merged_intervals"] = f"""WITH {_RN}, i AS (SELECT entity, "start", "end" + "start" % 15 AS "end" FROM rn),
k AS (SELECT *, coalesce("start" > max("end") OVER (PARTITION BY entity ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 6, true)::INT AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS grp FROM k)
SELECT entity, min("start") AS "start", max("end") AS "end" FROM g GROUP BY entity, grp"""


@query
def sliding_overlap(spark, sf_dir):
    d = daily(spark, sf_dir)
    w = W.sliding(d, "x", 28, 7)
    return W.unslid(w, how="avg").join(W.unslid(w, how="max").withColumnRenamed("x", "top"), ["entity", "idx"]).select("entity", "idx", *r6("x", "top"))


SQL["sliding_overlap"] = f"""WITH {_D}, m AS (SELECT entity, max(idx) AS hi FROM d GROUP BY 1),
w AS (SELECT d.entity, d.idx, d.x FROM d JOIN m ON m.entity = d.entity JOIN (SELECT idx AS st, entity FROM d WHERE idx % 7 = 0) s ON s.entity = d.entity AND d.idx >= st AND d.idx < st + 28 AND st + 27 <= hi)
SELECT entity, idx, round(avg(x), 6) AS x, round(max(x), 6) AS top FROM w GROUP BY 1, 2"""


# ---------------------------------------------------------------- evaluation


@query
def event_detail(spark, sf_dir):
    _, ev, _, fl = scored(spark, sf_dir)
    return E.event_detail(fl, ev.drop("add")).select("entity", "event_id", "type", "severity", "duration", "detected", F.col("delay").cast("double").alias("delay"), *r6("range_cov", "true_kwh"))


SQL["event_detail"] = f'WITH {_DET} SELECT entity, event_id::INT AS event_id, type, severity::INT AS severity, ("end" - "start")::BIGINT AS duration, hit IS NOT NULL AS detected, (hit - "start")::DOUBLE AS delay, round(range_cov, 6) AS range_cov, round(true_kwh, 6) AS true_kwh FROM ed'


@query
def detection_metrics(spark, sf_dir):
    _, ev, _, fl = scored(spark, sf_dir)
    m = E.detection(fl, ev.drop("add"))
    return m.select("entity", "n_events", "tp_events", "n_runs", "tp_runs", *r6("precision", "recall", "f1", "detection_delay", "false_alarm_rate", "range_precision", "range_recall", "range_f1"))


SQL["detection_metrics"] = f"""WITH {_DET},
e AS (SELECT entity, count(*) AS n_events, count(hit) AS tp_events, avg(hit - "start") AS detection_delay, avg(range_cov) AS range_recall FROM ed GROUP BY 1),
r AS (SELECT entity, count(*) AS n_runs, count(*) FILTER (overlap > 0) AS tp_runs, avg(overlap) AS range_precision FROM rd GROUP BY 1),
a AS (SELECT entity, avg(flag::INT::DOUBLE) AS far FROM fe WHERE NOT on_ GROUP BY 1),
m AS (SELECT e.*, coalesce(n_runs, 0) AS n_runs, coalesce(tp_runs, 0) AS tp_runs, coalesce(range_precision, 0) AS range_precision, coalesce(far, 0) AS false_alarm_rate,
  tp_events / n_events AS recall, CASE WHEN n_runs > 0 THEN tp_runs / n_runs ELSE 0 END AS precision FROM e LEFT JOIN r ON r.entity = e.entity LEFT JOIN a ON a.entity = e.entity)
SELECT entity, n_events, tp_events, n_runs, tp_runs, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1,
  round(detection_delay, 6) AS detection_delay, round(false_alarm_rate, 6) AS false_alarm_rate, round(range_precision, 6) AS range_precision, round(range_recall, 6) AS range_recall,
  round(CASE WHEN range_precision + range_recall > 0 THEN 2 * range_precision * range_recall / (range_precision + range_recall) ELSE 0 END, 6) AS range_f1 FROM m"""


@query
def type_severity_recall(spark, sf_dir):
    _, ev, _, fl = scored(spark, sf_dir)
    return E.recall_by(E.event_detail(fl, ev.drop("add")), "type", "severity", total=True).select(
        F.coalesce("type", F.lit("all")).alias("type"), F.coalesce(F.col("severity").cast("string"), F.lit("all")).alias("severity"), "n", *r6("recall", "delay")
    )


SQL["type_severity_recall"] = f"""WITH {_DET} SELECT coalesce(type, 'all') AS type, coalesce(severity::VARCHAR, 'all') AS severity, count(*) AS n, round(avg((hit IS NOT NULL)::INT::DOUBLE), 6) AS recall, round(avg(hit - "start"), 6) AS delay FROM ed GROUP BY ROLLUP (type, severity)"""


@query
def missed_events(spark, sf_dir):
    _, ev, _, fl = scored(spark, sf_dir)
    rows = IV.rows_in(fl.where("flag").select("entity", "idx"), ev.select("entity", "event_id", "start", "end"))
    return ev.select("entity", "event_id", *r6("true_kwh")).join(rows.select("entity", "event_id").distinct(), ["entity", "event_id"], "left_anti")


SQL["missed_events"] = f"WITH {_DET} SELECT entity, event_id::INT AS event_id, round(true_kwh, 6) AS true_kwh FROM ed WHERE hit IS NULL"


@query
def label_overlap(spark, sf_dir):
    d, _, _, fl = scored(spark, sf_dir)
    lab = test_span(d).select("entity", "idx", (F.col("idx") % 50 < 4).cast("int").alias("anomaly"))
    return E.label_overlap(fl, lab).select("entity", *r6("label_rate", "alarm_rate", "alarm_precision", "label_recall", "run_precision"))


SQL["label_overlap"] = f"""WITH {_RN}, b AS (SELECT entity, idx, flag, idx % 50 < 4 AS lab FROM fl),
r AS (SELECT rn.entity, avg((SELECT max(lab::INT) FROM b WHERE b.entity = rn.entity AND b.idx >= rn."start" AND b.idx < rn."end")::DOUBLE) AS run_precision FROM rn GROUP BY 1)
SELECT b.entity, round(avg(lab::INT::DOUBLE), 6) AS label_rate, round(avg(flag::INT::DOUBLE), 6) AS alarm_rate, round(count(*) FILTER (flag AND lab) / nullif(count(*) FILTER (flag), 0), 6) AS alarm_precision,
  round(count(*) FILTER (flag AND lab) / count(*) FILTER (lab), 6) AS label_recall, round(any_value(run_precision), 6) AS run_precision FROM b LEFT JOIN r ON r.entity = b.entity GROUP BY 1"""


@query
def duration_bins(spark, sf_dir):
    r = W.runs(scored(spark, sf_dir)[3])
    return r.groupBy(E.duration_bins(r).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("end") - F.col("start")), 6).alias("mean"))


SQL["duration_bins"] = f"""WITH {_RN}, b AS (SELECT "end" - "start" AS n FROM rn)
SELECT (CASE WHEN n <= 2 THEN 0 WHEN n <= 6 THEN 1 WHEN n <= 24 THEN 2 ELSE 3 END)::INT AS bin, count(*) AS n, round(avg(n), 6) AS mean FROM b GROUP BY 1"""


@query
def alarm_attribution(spark, sf_dir):
    d, ev, _, fl = scored(spark, sf_dir)
    return E.alarm_attribution(fl, ev, test_span(d))


SQL["alarm_attribution"] = f"""WITH {_DET},
f AS (SELECT fe.*, EXISTS (SELECT 1 FROM ev WHERE ev.entity = fe.entity AND fe.idx >= ev."start" - 24 AND fe.idx < ev."end" + 24) AS edge,
  (SELECT any_value(rn."end" - rn."start") FROM rn WHERE rn.entity = fe.entity AND fe.idx >= rn."start" AND fe.idx < rn."end") AS len FROM fe WHERE flag AND NOT on_)
SELECT CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 9 THEN 'morning' WHEN hour(ts) < 18 THEN 'day' ELSE 'evening' END AS band, isodow(ts) - 1 >= 5 AS weekend, edge,
  CASE WHEN len <= 1 THEN '1' WHEN len <= 6 THEN '2-6' ELSE '7+' END AS run_length, count(*) AS n FROM f GROUP BY ALL"""


#: Fusion weights that are compared; the larger of the two scores is one more choice.
WEIGHTS = tuple(k / 10 for k in range(11))


def validation_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(events planted in the validation span, its rows with the short score s and the long one)."""
    d = daily(spark, sf_dir)
    ev = planted(d).where("start + 40 < 340")
    rows = ev.select("entity", "add", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("span_idx"), F.lit("val").alias("span"))
    v = d.join(rows, ["entity", "span", "span_idx"], "left").withColumn("x", F.col("x") + F.coalesce("add", F.lit(0.0))).where("span = 'val'").drop("idx").withColumnRenamed("span_idx", "idx")
    tr = d.where("span = 'train'")
    return ev, S.long_z(S.slot_z(v, tr, "slot"), tr, window=28, least=7)


@query
def fusion_grid(spark, sf_dir):
    """Micro F1 on the validation span for each fusion weight and for the larger score, and the best
    (ties: the first). A choice and an entity are one key, so all choices are flagged in one plan."""
    ev, z = validation_scores(spark, sf_dir)
    choices = [(f"{w:.1f}", S.fused(w)) for w in WEIGHTS] + [("max", S.fused_max())]
    options = F.explode(F.array(*[F.struct(F.lit(n).alias("option"), c.alias("s")) for n, c in choices])).alias("o")
    key = lambda option: F.struct(option.alias("option"), F.col("entity")).alias("entity")
    fl = z.select("entity", "idx", options).select(key(F.col("o.option")), "idx", "o.s")
    fl = stored(W.trailing_flags(fl, window=112), "flags")
    every = ev.withColumn("option", F.explode(F.array(*[F.lit(n) for n, _ in choices]))).withColumn("entity", key(F.col("option"))).drop("option", "add")
    m = E.micro_f1(fl, every, [F.col("entity.option").alias("option")])
    first = F.row_number().over(Window.orderBy(F.desc("micro_f1"), "option"))  # of twelve rows
    return m.withColumn("chosen", first == 1).select("option", "tp_events", "n_events", "tp_runs", "n_runs", *r6("micro_f1"), "chosen")


_FUSE = _D + f""",
sc AS (SELECT entity, round(stddev_pop(x), 3) AS sd FROM d WHERE span = 'train' GROUP BY 1),
ev AS (SELECT entity, k AS event_id, 180 + 60 * k AS "start", 180 + 60 * k + 4 + 6 * k AS "end", (k // 2 + 1) * sd AS add FROM sc, range(6) AS r(k) WHERE 180 + 60 * k + 40 < 340),
v AS (SELECT d.entity, span_idx AS idx, x + coalesce(add, 0) AS x, slot FROM d LEFT JOIN ev ON d.entity = ev.entity AND span_idx >= ev."start" AND span_idx < ev."end" WHERE span = 'val'),
tr AS (SELECT * FROM d WHERE span = 'train'),
{_mad('pm', 'tr', 'entity')}, {_mad('sm', 'tr', 'entity, slot')},
lt AS (SELECT entity, CASE WHEN count(x) OVER w >= 7 THEN pow(avg(x) OVER w, 2) END AS x FROM tr WINDOW w AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)), {_mad('lm', 'lt', 'entity')},
z0 AS (SELECT v.*, (v.x - CASE WHEN sm.n >= 20 THEN sm.med ELSE pm.med END) / (CASE WHEN sm.n >= 20 THEN sm.mad ELSE pm.mad END + 1e-9) AS s1,
  CASE WHEN count(v.x) OVER w >= 7 THEN pow(avg(v.x) OVER w, 2) END AS q FROM v JOIN pm ON v.entity = pm.entity LEFT JOIN sm ON v.entity = sm.entity AND v.slot = sm.slot
  WINDOW w AS (PARTITION BY v.entity ORDER BY v.idx ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
z1 AS (SELECT z0.*, (q - med) / (mad + 1e-9) AS s2 FROM z0 JOIN lm ON lm.entity = z0.entity)"""


_FUSED = [("0.0", "s2"), *[(f"{w:.1f}", f"{w}::DOUBLE * s1 + {1 - w!r}::DOUBLE * s2") for w in WEIGHTS[1:-1]], ("1.0", "s1"), ("max", "CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN greatest(s1, s2) END")]


def _fusion_sql() -> str:
    parts, picks = [], []
    for i, (w, s) in enumerate(_FUSED):
        parts.append(f"y{i} AS (SELECT entity, idx, CAST({s} AS DOUBLE) AS s FROM z1)")
        parts.append(_flagger(f"y{i}", _LAG, "111 PRECEDING AND CURRENT ROW", f"g{i}_").replace(">= 84", ">= 28"))
        parts.append(_runs(f"g{i}_", f"n{i}_"))
        picks.append(
            f"""SELECT '{w}' AS option, (SELECT count(*) FROM ev WHERE EXISTS (SELECT 1 FROM g{i}_ g WHERE g.entity = ev.entity AND flag AND g.idx >= ev."start" AND g.idx < ev."end")) AS tp_events, (SELECT count(*) FROM ev) AS n_events,
  (SELECT count(*) FROM n{i}_ r WHERE EXISTS (SELECT 1 FROM ev WHERE ev.entity = r.entity AND r."start" < ev."end" AND ev."start" < r."end")) AS tp_runs, (SELECT count(*) FROM n{i}_) AS n_runs"""
        )
    body = " UNION ALL ".join(picks)
    return f"""WITH {_FUSE}, {', '.join(parts)}, m0 AS ({body}), m1 AS (SELECT *, tp_runs / greatest(n_runs, 1) AS p, tp_events / greatest(n_events, 1) AS r FROM m0),
m2 AS (SELECT *, 2 * p * r / greatest(p + r, 1e-9) AS f FROM m1)
SELECT option, tp_events::BIGINT AS tp_events, n_events::BIGINT AS n_events, tp_runs::BIGINT AS tp_runs, n_runs::BIGINT AS n_runs, round(f, 6) AS micro_f1, row_number() OVER (ORDER BY f DESC, option) = 1 AS chosen FROM m2"""


SQL["fusion_grid"] = _fusion_sql()


# ---------------------------------------------------------------- waste


@query
def waste_ops(spark, sf_dir):
    d, ev, _, fl = scored(spark, sf_dir)
    w = WS.decomposition(residual(d, ev), fl, ev.drop("add"))
    return w.select("entity", *[F.round(c, 4).alias(c) for c in ("est_kwh", "true_kwh", "delta_kwh", "matched_err_kwh", "false_add_kwh", "unmatched_ev_flagged_kwh", "missed_kwh", "frac_events_matched")])


def _decomp(rows: str) -> str:
    return f"""SELECT e.entity, est AS est_kwh, tt AS true_kwh, est - tt AS delta_kwh, m - tm AS matched_err_kwh, fa AS false_add_kwh, u AS unmatched_ev_flagged_kwh, tt - tm AS missed_kwh, fm AS frac_events_matched, cov AS window_cov
FROM (SELECT entity, sum(true_kwh) AS tt, coalesce(sum(true_kwh) FILTER (hit IS NOT NULL), 0) AS tm, avg((hit IS NOT NULL)::INT::DOUBLE) AS fm FROM ed GROUP BY 1) t
JOIN (SELECT entity, coalesce(sum(rc) FILTER (in_), 0) AS est, coalesce(sum(rc) FILTER (in_ AND det = 1), 0) AS m, coalesce(sum(rc) FILTER (in_ AND det = 0), 0) AS u, coalesce(sum(rc) FILTER (in_ AND det IS NULL), 0) AS fa, avg(in_::INT::DOUBLE) FILTER (det IS NOT NULL) AS cov
  FROM (SELECT res.entity, res.idx, greatest(coalesce(resid, 0), 0) AS rc, {rows} AS in_, (SELECT max((hit IS NOT NULL)::INT) FROM ed WHERE ed.entity = res.entity AND res.idx >= ed."start" AND res.idx < ed."end") AS det FROM res) GROUP BY 1) e ON e.entity = t.entity"""


_FLAGGED = "EXISTS (SELECT 1 FROM fl WHERE fl.entity = res.entity AND fl.idx = res.idx AND fl.flag)"
_W4 = ", ".join(f"round({c}, 4) AS {c}" for c in ("est_kwh", "true_kwh", "delta_kwh", "matched_err_kwh", "false_add_kwh", "unmatched_ev_flagged_kwh", "missed_kwh", "frac_events_matched"))
SQL["waste_ops"] = f"WITH {_DET}{_RES} SELECT entity, {_W4} FROM ({_decomp(_FLAGGED)})"


@query
def waste_oracle(spark, sf_dir):
    d = daily(spark, sf_dir)
    ev = planted(d)
    return WS.oracle(residual(d, ev), ev.drop("add")).select("entity", *[F.round(c, 4).alias(c) for c in ("true_kwh", "clip_kwh", "signed_kwh", "floor_kwh")])


SQL["waste_oracle"] = f"""WITH {_EV}{_RES},
ns AS (SELECT entity, resid AS x FROM res WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.entity = res.entity AND res.idx >= ev."start" AND res.idx < ev."end")), {_mad('nm', 'ns', 'entity')},
o AS (SELECT ev.entity, event_id, any_value(true_kwh) AS tk, sum(greatest(resid, 0)) AS clip, sum(resid) AS signed, count(*) AS n FROM ev JOIN res ON ev.entity = res.entity AND res.idx >= ev."start" AND res.idx < ev."end" WHERE resid IS NOT NULL GROUP BY 1, 2)
SELECT o.entity, round(sum(tk), 4) AS true_kwh, round(sum(clip), 4) AS clip_kwh, round(sum(signed), 4) AS signed_kwh, round(sum(greatest(clip - o.n * mad / sqrt(2 * pi()), 0)), 4) AS floor_kwh FROM o JOIN nm ON nm.entity = o.entity GROUP BY 1"""


@query
def waste_extensions(spark, sf_dir):
    d, ev, t, fl = scored(spark, sf_dir)
    z = t.select("entity", "idx", F.col("s").alias("z"))
    x = WS.extensions(residual(d, ev), z, fl, ev.drop("add"))
    return x.select("entity", "mode", *[F.round(c, 4).alias(c) for c in ("est_kwh", "matched_err_kwh", "false_add_kwh", "missed_kwh", "bias", "window_cov")])


def _merge(src: str, out: str) -> str:
    return f"""{out}k AS (SELECT *, coalesce("start" > max("end") OVER (PARTITION BY entity ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 6, true)::INT AS new FROM {src}),
{out}g AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS grp FROM {out}k),
{out} AS (SELECT entity, min("start") AS "start", max("end") AS "end" FROM {out}g GROUP BY entity, grp)"""


def _ext_sql() -> str:
    ah = """ah AS (SELECT rn.entity, rn."start" AS st, z.idx, z.s AS z FROM rn JOIN z ON z.entity = rn.entity AND z.idx >= rn."start" AND z.idx < rn."start" + 336)"""
    parts, picks = [ah], [f"SELECT 'none' AS mode, * FROM ({_decomp(_FLAGGED)})"]
    parts.append("""lo AS (SELECT *, idx - coalesce(max(CASE WHEN NOT coalesce(abs(z) < 2.0, false) THEN idx END) OVER (PARTITION BY entity, st ORDER BY idx), st - 1) AS still FROM ah)""")
    for k in (6, 12):
        parts.append(f"""w{k} AS (SELECT entity, st AS "start", coalesce(min(idx) FILTER (still >= {k}), max(idx)) + 1 AS "end" FROM lo GROUP BY 1, 2), {_merge(f'w{k}', f'v{k}')}""")
        inside = f'EXISTS (SELECT 1 FROM v{k} v WHERE v.entity = res.entity AND res.idx >= v."start" AND res.idx < v."end")'
        picks.append(f"SELECT 'z{k}' AS mode, * FROM ({_decomp(inside)})")
    parts.append("""cp AS (SELECT *, sum(z - 1.0::DOUBLE) OVER (PARTITION BY entity, st ORDER BY idx) AS p FROM ah),
cs AS (SELECT *, p - least(0, min(p) OVER (PARTITION BY entity, st ORDER BY idx)) AS c FROM cp),
ct AS (SELECT *, row_number() OVER (PARTITION BY entity, st ORDER BY c DESC, idx DESC) AS k, max(idx) OVER (PARTITION BY entity, st) AS last FROM cs),
wc AS (SELECT entity, st AS "start", least(greatest(idx + 1, st + 6), last + 1) AS "end" FROM ct WHERE k = 1)""" + ", " + _merge("wc", "vc"))
    picks.append("SELECT 'cusum' AS mode, * FROM (" + _decomp('EXISTS (SELECT 1 FROM vc v WHERE v.entity = res.entity AND res.idx >= v."start" AND res.idx < v."end")') + ")")
    cols = ", ".join(f"round({c}, 4) AS {c}" for c in ("est_kwh", "matched_err_kwh", "false_add_kwh", "missed_kwh", "window_cov"))
    return f"WITH {_DET}{_RES}, {', '.join(parts)}, u AS ({' UNION ALL '.join(picks)}) SELECT entity, mode, {cols}, round((est_kwh - true_kwh) / true_kwh, 4) AS bias FROM u"


SQL["waste_extensions"] = _ext_sql()


@query
def chosen_extension(spark, sf_dir):
    d, ev, t, fl = scored(spark, sf_dir)
    z = t.select("entity", "idx", F.col("s").alias("z"))
    return WS.chosen_mode(WS.extensions(residual(d, ev), z, fl, ev.drop("add"))).select("mode", F.round("obj", 4).alias("obj"))


SQL["chosen_extension"] = SQL["waste_extensions"].rpartition(" SELECT entity, mode")[0] + """ SELECT mode, round(obj, 4) AS obj FROM (SELECT mode, median(abs((est_kwh - true_kwh) / true_kwh)) AS obj FROM u GROUP BY 1) ORDER BY round(obj, 9), list_position(['none', 'z6', 'z12', 'cusum'], mode) LIMIT 1"""


@query
def level_bias(spark, sf_dir):
    d = daily(spark, sf_dir)
    ev = planted(d)
    return WS.level_bias(residual(d, ev), ev.drop("add"), panels.scales(d)).select("entity", "event_id", *r6("level_bias"))


SQL["level_bias"] = f"""WITH {_EV}{_RES}, m AS (SELECT ev.entity, event_id, any_value(true_kwh) AS tk, avg(resid) AS m, count(*) AS n FROM ev JOIN res ON ev.entity = res.entity AND res.idx >= ev."start" AND res.idx < ev."end" GROUP BY 1, 2)
SELECT m.entity, event_id::INT AS event_id, round((m - tk / n) / sd, 6) AS level_bias FROM m JOIN sc ON sc.entity = m.entity"""


# ---------------------------------------------------------------- statistics

_MT = """mt AS (SELECT 's' || (l_suppkey % 5) || '_e' || (l_suppkey % 25) AS entity, 's' || (l_suppkey % 5) AS site, 'm' || (l_partkey % 4) AS model, (l_orderkey % 3)::INT AS seed, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
cells AS (SELECT entity, avg(v) FILTER (model = 'm0') AS m0, avg(v) FILTER (model = 'm1') AS m1, avg(v) FILTER (model = 'm2') AS m2, avg(v) FILTER (model = 'm3') AS m3 FROM mt GROUP BY 1 HAVING count(DISTINCT model) = 4),
fx AS (SELECT entity, unnest([{'family': 'primary', 'contrast': 'first factor', 'd': 0.5 * ((m0 - m2) + (m1 - m3))}, {'family': 'primary', 'contrast': 'second factor', 'd': 0.5 * ((m0 - m1) + (m2 - m3))},
  {'family': 'primary', 'contrast': 'interaction', 'd': (m0 - m1) - (m2 - m3)}, {'family': 'simple', 'contrast': 'first | level 1', 'd': m0 - m2}, {'family': 'simple', 'contrast': 'first | level 2', 'd': m1 - m3},
  {'family': 'simple', 'contrast': 'second | level 1', 'd': m0 - m1}, {'family': 'simple', 'contrast': 'second | level 2', 'd': m2 - m3}], recursive := true) FROM cells),
mo AS (SELECT family, contrast, count(d) AS n, avg(d) AS estimate, stddev_samp(d) AS sd, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses FROM fx GROUP BY 1, 2)"""


def contrasts(spark, sf_dir):
    return X.factorial(X.paired(metric_table(spark, sf_dir), "v", MODELS), "m0", "m1", "m2", "m3")


@query
def factorial_contrasts(spark, sf_dir):
    return contrasts(spark, sf_dir).select("entity", "family", "contrast", F.round("d", 9).alias("d"))


SQL["factorial_contrasts"] = f"WITH {_MT} SELECT entity, family, contrast, round(d, 9) AS d FROM fx"


@query
def paired_ttest(spark, sf_dir):
    return X.moments(contrasts(spark, sf_dir), ["family", "contrast"]).select("family", "contrast", "n", "wins", "losses", F.round("estimate", 9).alias("estimate"), F.round("sd", 9).alias("sd"), *r6("t"))


SQL["paired_ttest"] = f"WITH {_MT} SELECT family, contrast, n, wins, losses, round(estimate, 9) AS estimate, round(sd, 9) AS sd, round(estimate / (sd / sqrt(n)), 6) AS t FROM mo"


@query
def holm_adjust(spark, sf_dir):
    """Holm within families, of pseudo p values 1 / (1 + t * t)."""
    m = X.moments(contrasts(spark, sf_dir), ["family", "contrast"]).withColumn("p", 1 / (1 + F.col("t") * F.col("t")))
    return X.holm(m, ["family"]).select("family", "contrast", *r6("p", "holm_p"))


SQL["holm_adjust"] = f"""WITH {_MT}, p AS (SELECT family, contrast, 1 / (1 + pow(estimate / (sd / sqrt(n)), 2)) AS p FROM mo),
s AS (SELECT *, least((count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, contrast) + 1) * p, 1.0) AS st FROM p)
SELECT family, contrast, round(p, 6) AS p, round(max(st) OVER (PARTITION BY family ORDER BY p, contrast ROWS UNBOUNDED PRECEDING), 6) AS holm_p FROM s"""


@query
def sign_flip(spark, sf_dir):
    return X.sign_flip(contrasts(spark, sf_dir), ["family", "contrast"], n=10_000).select("family", "contrast", *r6("p_perm"))


_U = "('0x' || substr(md5({}), 1, 12))::BIGINT::DOUBLE / 281474976710656.0"
SQL["sign_flip"] = f"""WITH {_MT}, nl AS (SELECT family, contrast, rep, abs(avg(CASE WHEN {_U.format("'flip|' || entity || '|' || rep")} < 0.5 THEN -d ELSE d END)) AS m FROM fx, range(10000) AS r(rep) GROUP BY 1, 2, 3)
SELECT family, contrast, round((1 + count(*) FILTER (m >= abs(estimate) - 1e-15)) / 10001, 6) AS p_perm FROM nl JOIN mo USING (family, contrast) GROUP BY 1, 2"""


@query
def bootstrap_ci(spark, sf_dir):
    d = contrasts(spark, sf_dir).withColumn("site", C.site_of(F.col("entity")))
    a = X.bootstrap(d, ["family", "contrast"], "entity", 2000)
    b = X.bootstrap(d, ["family", "contrast"], "site", 2000).withColumnsRenamed({"boot_lo": "cluster_lo", "boot_hi": "cluster_hi"})
    return a.join(b, ["family", "contrast"]).select("family", "contrast", *[F.round(c, 8).alias(c) for c in ("boot_lo", "boot_hi", "cluster_lo", "cluster_hi")])


def _boot(unit: str, a: str, n: int = 2000) -> str:
    return f"""{a}u AS (SELECT family, contrast, {unit} AS un, sum(d) AS s, count(d) AS c FROM fx GROUP BY 1, 2, 3),
{a}i AS (SELECT *, row_number() OVER (PARTITION BY family, contrast ORDER BY un) - 1 AS i, count(*) OVER (PARTITION BY family, contrast) AS m FROM {a}u),
{a}d AS (SELECT family, contrast, rep, floor({_U.format("'boot|' || rep || '|' || i")} * m)::INT AS pick FROM {a}i, range({n}) AS r(rep)),
{a}m AS (SELECT x.family, x.contrast, rep, sum(s) / sum(c) AS mean FROM {a}d x JOIN {a}i y ON x.family = y.family AND x.contrast = y.contrast AND x.pick = y.i GROUP BY 1, 2, 3),
{a} AS (SELECT family, contrast, quantile_cont(mean, (1 - 0.95::DOUBLE) / 2) AS lo, quantile_cont(mean, 1 - (1 - 0.95::DOUBLE) / 2) AS hi FROM {a}m GROUP BY 1, 2)"""


SQL["bootstrap_ci"] = f"""WITH {_MT}, {_boot('entity', 'be')}, {_boot("split_part(entity, '_', 1)", 'bs')}
SELECT be.family, be.contrast, round(be.lo, 8) AS boot_lo, round(be.hi, 8) AS boot_hi, round(bs.lo, 8) AS cluster_lo, round(bs.hi, 8) AS cluster_hi FROM be JOIN bs ON be.family = bs.family AND be.contrast = bs.contrast"""


@query
def correlation_slope(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return X.correlation(li, "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", *r6("pearson", "spearman"), F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


SQL["correlation_slope"] = """WITH r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM r GROUP BY 1"""


@query
def seed_means(spark, sf_dir):
    return E.mean_of_groups(metric_table(spark, sf_dir), ["model", "seed"], ["model"], "v").select("model", "n", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


SQL["seed_means"] = f"WITH {_MT}, s AS (SELECT model, seed, avg(v) AS m FROM mt GROUP BY 1, 2) SELECT model, count(*) AS n, round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS sd FROM s GROUP BY 1"


@query
def signed_rank(spark, sf_dir):
    return X.signed_rank(contrasts(spark, sf_dir).withColumn("d", F.round("d", 9)), ["family", "contrast"]).select("family", "contrast", "n", "w_plus", *r6("z"))


SQL["signed_rank"] = f"""WITH {_MT}, f AS (SELECT family, contrast, round(d, 9) AS d FROM fx),
x AS (SELECT family, contrast, d, rank() OVER (PARTITION BY family, contrast ORDER BY abs(d)) + (count(*) OVER (PARTITION BY family, contrast, abs(d)) - 1) / 2 AS rk, count(*) OVER (PARTITION BY family, contrast, abs(d)) AS c FROM f WHERE d <> 0),
s AS (SELECT family, contrast, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE AS w_plus, sum((c * c - 1) / 48) AS tied FROM x GROUP BY 1, 2)
SELECT family, contrast, n, w_plus, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied), 6) AS z FROM s"""


@query
def modal_model(spark, sf_dir):
    best = X.best(metric_table(spark, sf_dir), ["entity", "seed"], "v", ["model"])
    return X.mode(best, ["seed"], "model").select("seed", "model", "n")


SQL["modal_model"] = f"""WITH {_MT}, b AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY entity, seed ORDER BY v DESC, model) = 1), c AS (SELECT seed, model, count(*) AS n FROM b GROUP BY 1, 2)
SELECT seed, model, n FROM c QUALIFY row_number() OVER (PARTITION BY seed ORDER BY n DESC, model) = 1"""


@query
def weighted_means(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(A.weighted_mean("l_discount", "l_quantity"), 9).alias("mean"))


SQL["weighted_means"] = "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY 1"


@query
def column_means(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", F.when(F.col("l_linenumber") > 2, F.col("l_tax")).otherwise(float("nan")).alias("l_tax"))
    return A.means(li, ["l_returnflag"]).select("l_returnflag", *r6("l_quantity", "l_discount", "l_tax"))


SQL["column_means"] = "SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(CASE WHEN l_linenumber > 2 THEN l_tax END), 6) AS l_tax FROM lineitem GROUP BY 1"


@query
def run_length_spread(spark, sf_dir):
    r = W.runs(scored(spark, sf_dir)[3]).withColumn("length", (F.col("end") - F.col("start")).cast("double"))
    return A.spread(r, ["entity"], "length", (1, 6)).select("entity", "n", *r6("q25", "q50", "q75", "q90", "share_1", "share_6"))


SQL["run_length_spread"] = f"""WITH {_RN}, l AS (SELECT entity, ("end" - "start")::DOUBLE AS n_ FROM rn)
SELECT entity, count(*) AS n, round(quantile_cont(n_, 0.25), 6) AS q25, round(quantile_cont(n_, 0.5), 6) AS q50, round(quantile_cont(n_, 0.75), 6) AS q75, round(quantile_cont(n_, 0.9), 6) AS q90,
  round(avg((n_ <= 1)::INT::DOUBLE), 6) AS share_1, round(avg((n_ <= 6)::INT::DOUBLE), 6) AS share_6 FROM l GROUP BY 1"""


@query
def seen_unseen(spark, sf_dir):
    m = metric_table(spark, sf_dir).withColumn("seen", F.col("site").isin("s0", "s1", "s2"))
    return A.seen_unseen(m, "v", ["model"]).select("model", *[F.round(c, 9).alias(c) for c in ("on_seen", "on_unseen", "gap")])


SQL["seen_unseen"] = f"""WITH {_MT}, g AS (SELECT model, avg(v) FILTER (site IN ('s0', 's1', 's2')) AS a, avg(v) FILTER (site NOT IN ('s0', 's1', 's2')) AS b FROM mt GROUP BY 1)
SELECT model, round(a, 9) AS on_seen, round(b, 9) AS on_unseen, round(a - b, 9) AS gap FROM g"""


@query
def injection_realism(spark, sf_dir):
    d = daily(spark, sf_dir)
    ev = planted(d)
    delta = ev.select("entity", F.col("add").alias("delta"), F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("idx"))
    clean = S.profile_residual(test_span(d), S.slot_profile(d.where("span = 'train'")), out="resid").select("entity", "idx", "resid")
    none = test_span(d).where("x = 0").select("entity", "idx")
    return A.realism(delta, ev, clean, test_span(d), none).select("entity", "event_id", "type", "severity", "filled", *[F.round(c, 5).alias(c) for c in ("mean_sigma", "peak_sigma", "peak", "energy_share")])


SQL["injection_realism"] = f"""WITH {_EV}, p AS (SELECT entity, slot, median(x) AS med FROM d WHERE span = 'train' GROUP BY 1, 2), u AS (SELECT d.entity, span_idx AS idx, d.x AS load, d.x - med AS x FROM d LEFT JOIN p ON p.entity = d.entity AND p.slot = d.slot WHERE span = 'test'),
{_mad('nm', 'u', 'entity')}
SELECT ev.entity, event_id::INT AS event_id, any_value(type) AS type, any_value(severity)::INT AS severity, count(*) FILTER (load = 0) AS filled, round(avg(add / nullif(mad, 0)), 5) AS mean_sigma, round(max(add / nullif(mad, 0)), 5) AS peak_sigma,
  round(max(add), 5) AS peak, round(sum(add) / nullif(sum(load), 0), 5) AS energy_share FROM ev JOIN u ON u.entity = ev.entity AND u.idx >= ev."start" AND u.idx < ev."end" JOIN nm ON nm.entity = ev.entity GROUP BY 1, 2"""


@query
def gross_error(spark, sf_dir):
    d, ev, _, fl = scored(spark, sf_dir)
    return WS.gross_error(WS.decomposition(residual(d, ev), fl, ev.drop("add")).withColumn("model", F.lit("slot")), ["model"]).select("model", *r6("gross_rel", "bias"))


SQL["gross_error"] = f"""WITH {_DET}{_RES}, w AS ({_decomp(_FLAGGED)})
SELECT 'slot' AS model, round(sum(abs(matched_err_kwh) + abs(false_add_kwh) + abs(missed_kwh)) / sum(true_kwh), 6) AS gross_rel, round((sum(est_kwh) - sum(true_kwh)) / sum(true_kwh), 6) AS bias FROM w"""


@query
def equivalence_tests(spark, sf_dir):
    """t tests with intervals, equivalence within 0.03, and Holm's adjustment within families."""
    m = X.holm(X.t_tests(X.moments(contrasts(spark, sf_dir), ["family", "contrast"])), ["family"], "p_t")
    return m.select("family", "contrast", "n", "wins", "losses", *[F.round(c, 8).alias(c) for c in ("estimate", "sd", "p_t", "ci_lo", "ci_hi", "p_tost", "tost_lo", "tost_hi", "holm_p")], *r6("t"))


def _central(t: str) -> str:
    """P(|T| <= t) for whole degrees of freedom: the finite sums of the even and of the odd case."""
    powers = lambda c, n: f"coalesce(list_sum(list_transform(range({n}), lambda j: exp({c}) * pow(df / (df + ({t}) * ({t})), j))), 0)"
    even, odd = powers("lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)", "df // 2"), powers("lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)", "(df - 1) // 2")
    return f"""CASE WHEN df % 2 = 0 THEN abs({t}) / sqrt(df + ({t}) * ({t})) * {even} ELSE 2 / pi() * (atan(abs({t}) / sqrt(df)) + abs({t}) * sqrt(df) / (df + ({t}) * ({t})) * {odd}) END"""


def _below(t: str) -> str:
    return f"(0.5 + sign({t}) * ({_central(t)}) / 2)"


# quantiles by Newton's steps from 0; mo has the moments of each contrast
_T = f"""tm AS (SELECT *, n - 1 AS df, sd / sqrt(n) AS se FROM mo),
tq AS (SELECT df, level, 0 AS i, 0::DOUBLE AS q FROM (SELECT DISTINCT df FROM tm), (VALUES (0.95::DOUBLE), (0.9::DOUBLE)) AS l(level)
  UNION ALL SELECT df, level, i + 1, q + (level - ({_central('q')})) / (2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + q * q / df, -(df + 1) / 2)) FROM tq WHERE i < 60),
tt AS (SELECT tm.*, 1 - ({_central('estimate / se')}) AS p_t, greatest(1 - {_below('(estimate + 0.03) / se')}, {_below('(estimate - 0.03) / se')}) AS p_tost,
  (SELECT q FROM tq WHERE tq.df = tm.df AND i = 60 AND level = 0.95::DOUBLE) AS q95, (SELECT q FROM tq WHERE tq.df = tm.df AND i = 60 AND level = 0.9::DOUBLE) AS q90 FROM tm),
ts AS (SELECT *, least((count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_t, contrast) + 1) * p_t, 1.0) AS st FROM tt),
th AS (SELECT *, max(st) OVER (PARTITION BY family ORDER BY p_t, contrast ROWS UNBOUNDED PRECEDING) AS holm_p FROM ts)"""
SQL["equivalence_tests"] = f"""WITH RECURSIVE {_MT}, {_T} SELECT family, contrast, n, wins, losses, round(estimate, 8) AS estimate, round(sd, 8) AS sd, round(p_t, 8) AS p_t, round(estimate - q95 * se, 8) AS ci_lo, round(estimate + q95 * se, 8) AS ci_hi,
  round(p_tost, 8) AS p_tost, round(estimate - q90 * se, 8) AS tost_lo, round(estimate + q90 * se, 8) AS tost_hi, round(holm_p, 8) AS holm_p, round(estimate / se, 6) AS t FROM th"""


@query
def pairwise_tests(spark, sf_dir):
    """Paired t tests of each two models over entities, Holm's adjustment over the six."""
    cells = X.paired(metric_table(spark, sf_dir), "v", MODELS)
    m = X.holm(X.t_tests(X.moments(X.pairs(cells, MODELS), ["family", "contrast"])), ["family"], "p_t")
    return m.select("contrast", "n", *[F.round(c, 8).alias(c) for c in ("estimate", "p_t", "holm_p")])


SQL["pairwise_tests"] = f"""WITH RECURSIVE {_MT.partition(",\nfx AS")[0]},
lo AS (UNPIVOT cells ON m0, m1, m2, m3 INTO NAME model VALUE v),
mo AS (SELECT 'pairs' AS family, a.model || ' - ' || b.model AS contrast, count(*) AS n, avg(a.v - b.v) AS estimate, stddev_samp(a.v - b.v) AS sd FROM lo a JOIN lo b ON a.entity = b.entity AND a.model < b.model GROUP BY 2), {_T}
SELECT contrast, n, round(estimate, 8) AS estimate, round(p_t, 8) AS p_t, round(holm_p, 8) AS holm_p FROM th"""


def _over(sum_of: str) -> str:
    """A sum over the groups g of (n, c)."""
    return f"list_sum(list_transform(g, lambda v: {sum_of}))"


_REML_W, _REML_WC = _over("v.n / (1 + {x} * v.n)"), _over("v.n / (1 + {x} * v.n) * v.c")
_REML_MU = f"({_REML_WC} / {_REML_W})"
_REML_Q = f"(within + {_over('v.n / (1 + {x} * v.n) * v.c * v.c')} - {_REML_WC} * {_REML_MU})"
_REML = f"(-0.5 * ((total - 1) * ln({_REML_Q} / (total - 1)) + {_over('ln(1 + {x} * v.n)')} + ln({_REML_W})))"


@query
def mixed_effects(spark, sf_dir):
    """Contrasts with a random intercept for each site, by REML."""
    d = contrasts(spark, sf_dir).withColumn("site", C.site_of(F.col("entity")))
    return X.random_intercept(d, ["family", "contrast"]).select("family", "contrast", F.round("mixed_est", 7).alias("mixed_est"), *r6("p_mixed"))


# the best of a grid of variance ratios, then thirds of the space between its neighbours; the normal tails by their series
SQL["mixed_effects"] = f"""WITH RECURSIVE {_MT},
gs AS (SELECT family, contrast, split_part(entity, '_', 1) AS site, count(*) AS n, avg(d) AS mean, sum(d * d) - count(*) * avg(d) * avg(d) AS ss FROM fx GROUP BY 1, 2, 3),
gw AS (SELECT family, contrast, sum(n)::DOUBLE AS n, sum(n * mean) / sum(n) AS mid, sum(ss) AS within FROM gs GROUP BY 1, 2),
gl AS (SELECT family, contrast, any_value(gw.n) AS total, any_value(mid) AS mid, any_value(within) AS within, list({{'n': gs.n::DOUBLE, 'c': mean - mid}} ORDER BY site) AS g FROM gs JOIN gw USING (family, contrast) GROUP BY 1, 2),
gg AS (SELECT *, CASE WHEN j = 0 THEN 0 ELSE pow(10.0::DOUBLE, -6 + (j - 1) / 20) END AS lam FROM gl, range(202) AS r(j)),
gb AS (SELECT family, contrast, total, within, g, mid, j FROM gg QUALIFY row_number() OVER (PARTITION BY family, contrast ORDER BY {_REML.format(x='lam')} DESC, j) = 1),
th AS (SELECT family, contrast, total, within, g, mid, 0 AS i, CASE WHEN j <= 1 THEN 0 ELSE pow(10.0::DOUBLE, -6 + (j - 2) / 20) END AS lo, pow(10.0::DOUBLE, -6 + least(j, 200) / 20) AS hi FROM gb
  UNION ALL SELECT family, contrast, total, within, g, mid, i + 1, CASE WHEN {_REML.format(x='(lo + (hi - lo) / 3)')} < {_REML.format(x='(hi - (hi - lo) / 3)')} THEN lo + (hi - lo) / 3 ELSE lo END,
    CASE WHEN {_REML.format(x='(lo + (hi - lo) / 3)')} < {_REML.format(x='(hi - (hi - lo) / 3)')} THEN hi ELSE hi - (hi - lo) / 3 END FROM th WHERE i < 60),
mx AS (SELECT *, CASE WHEN {_REML.format(x='0.0::DOUBLE')} >= {_REML.format(x='(lo + hi) / 2')} THEN 0 ELSE (lo + hi) / 2 END AS lam FROM th WHERE i = 60),
mz AS (SELECT family, contrast, mid + {_REML_MU.format(x='lam')} AS est, abs(mid + {_REML_MU.format(x='lam')}) / sqrt({_REML_Q.format(x='lam')} / (total - 1) / {_REML_W.format(x='lam')}) AS z FROM mx)
SELECT family, contrast, round(est, 7) AS mixed_est, round(CASE WHEN z > 9 THEN 0 ELSE 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(200), lambda k: exp((2 * k + 1) * ln(greatest(z, 1e-300)) + k * ln(2.0::DOUBLE) + lgamma(k + 1) - lgamma(2 * k + 2)))) END, 6) AS p_mixed FROM mz"""


@query
def waste_intervals(spark, sf_dir):
    """Errors of the estimated excess under each extension rule and the chosen one, with intervals over resampled entities and sites."""
    d, ev, t, fl = scored(spark, sf_dir)
    x = stored(WS.extensions(residual(d, ev), t.select("entity", "idx", F.col("s").alias("z")), fl, ev.drop("add")), "extensions")
    chosen = x.join(F.broadcast(WS.chosen_mode(x).select("mode")), "mode").withColumn("mode", F.lit("chosen"))  # one row
    ops = x.unionByName(chosen).withColumn("site", F.concat(F.lit("s"), (F.ascii("entity") % 2).cast("string")))
    one, many = (X.ratio_bootstrap(ops, ["mode"], unit) for unit in ("entity", "site"))
    both = one.join(many.select("mode", "stat", F.col("lo").alias("site_lo"), F.col("hi").alias("site_hi")), ["mode", "stat"])
    return both.select("mode", "stat", *r6("value", "lo", "hi", "site_lo", "site_hi"))


def _ratios(unit: str, a: str) -> str:
    """Replicates as repeated rows: sums and medians over them."""
    return f"""{a}i AS (SELECT mode, un, row_number() OVER (PARTITION BY mode ORDER BY un) - 1 AS i, count(*) OVER (PARTITION BY mode) AS m FROM (SELECT DISTINCT mode, {unit} AS un FROM po)),
{a}d AS (SELECT mode, rep, floor({_U.format("'boot|' || rep || '|' || i")} * m)::INT AS pick FROM {a}i, range(2000) AS r(rep)),
{a}r AS (SELECT po.*, rep FROM {a}d x JOIN {a}i y ON x.mode = y.mode AND x.pick = y.i JOIN po ON po.mode = y.mode AND po.{unit} = y.un UNION ALL SELECT po.*, -1 FROM po),
{a}s AS (SELECT mode, rep, sum(est_kwh) / sum(true_kwh) - 1 AS agg_bias, (abs(sum(matched_err_kwh)) + abs(sum(false_add_kwh)) + abs(sum(missed_kwh))) / sum(true_kwh) AS agg_gross_rel,
  sum(abs(matched_err_kwh) + abs(false_add_kwh) + abs(missed_kwh)) / sum(true_kwh) AS pb_gross_rel, median(abs(est_kwh / true_kwh - 1)) AS median_abs_rel_err FROM {a}r GROUP BY 1, 2),
{a}l AS (UNPIVOT {a}s ON agg_bias, agg_gross_rel, pb_gross_rel, median_abs_rel_err INTO NAME stat VALUE v),
{a} AS (SELECT mode, stat, max(v) FILTER (rep < 0) AS value, quantile_cont(v, 0.025::DOUBLE) FILTER (rep >= 0) AS lo, quantile_cont(v, 0.975::DOUBLE) FILTER (rep >= 0) AS hi FROM {a}l GROUP BY 1, 2)"""


SQL["waste_intervals"] = SQL["waste_extensions"].rpartition(" SELECT entity, mode")[0] + f""",
ch AS (SELECT mode FROM (SELECT mode, median(abs((est_kwh - true_kwh) / true_kwh)) AS obj FROM u GROUP BY 1) ORDER BY round(obj, 9), list_position(['none', 'z6', 'z12', 'cusum'], mode) LIMIT 1),
po AS MATERIALIZED (SELECT mode, entity, 's' || (ascii(entity) % 2) AS site, est_kwh, true_kwh, matched_err_kwh, false_add_kwh, missed_kwh FROM (SELECT * FROM u UNION ALL SELECT * REPLACE ('chosen' AS mode) FROM u WHERE mode = (SELECT mode FROM ch)) WHERE true_kwh > 0),
{_ratios('entity', 'ra')}, {_ratios('site', 'rb')}
SELECT mode, stat, round(ra.value, 6) AS value, round(ra.lo, 6) AS lo, round(ra.hi, 6) AS hi, round(rb.lo, 6) AS site_lo, round(rb.hi, 6) AS site_hi FROM ra JOIN rb USING (mode, stat)"""


# ---------------------------------------------------------------- without SQL: fits; streams


def _detector(spark, sf_dir, detector):
    d = daily(spark, sf_dir).withColumns(C.cyclic(F.col("ts"))).withColumns({"load": F.col("x"), "temp": C.climate_proxy(F.col("ts"), F.lit(40.0))})
    d = P.scale(d, ["load", "temp"]).withColumns({"load": F.col("z_load"), "temp": F.col("z_temp")}).drop("z_load", "z_temp")
    return M.score(d.where("span = 'test'"), FT.fit(d.where("span = 'train'"), detector)).select("entity", "idx", "s")


@query
def isolation_forest(spark, sf_dir):
    return _detector(spark, sf_dir, M.IsolationForest())


@query
def one_class_svm(spark, sf_dir):
    return _detector(spark, sf_dir, M.OneClassSVM())


@query
def dense_autoencoder(spark, sf_dir):
    return _detector(spark, sf_dir, M.Autoencoder())


@query
def stream_windows(spark, sf_dir):
    """Event-time hourly windows over the events files as a stream, run until all is read."""
    from ..streaming.online import windowed

    return panels.drained(spark, sf_dir, lambda s: windowed(s, "ts", "event_type", "value", "1 hour"), "append").select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 4).alias("total")
    )


# the watermark (latest event less an hour) keeps the last windows open
SQL["stream_windows"] = """SELECT strftime(date_trunc('hour', ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)::TIMESTAMP - INTERVAL 1 HOUR"""


@query
def stream_sessions(spark, sf_dir):
    from ..streaming.online import sessions

    return panels.drained(spark, sf_dir, lambda s: sessions(s, "ts", "user_id", "30 minutes"), "append").select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


# windows that touch are one session; the watermark keeps the last ones open
SQL["stream_sessions"] = """WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true)::INT AS new FROM events),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT user_id, count(*) AS n, strftime(min(ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS start FROM k GROUP BY user_id, k.k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


@query
def stream_online_flags(spark, sf_dir):
    """The online detector over the hourly panel as a stream whose rows come up to two and a half hours late, with the profile
    frozen on the panel's first rows."""
    from ..streaming.online import online_flags

    h = P.split(P.interpolated(hourly(spark, sf_dir)).withColumn("slot", C.hour_slot(F.col("ts"))))
    profile = stored(S.median_mad(reference(h), ["entity", "slot"]).drop("n"), "profile")
    rows = h.where("span = 'test'").select("entity", "ts", "x")
    out = panels.drained(spark, sf_dir, lambda s: online_flags(s, profile, C.hour_slot, window=72, delay="3 hours"), "append", rows, late=150)
    return out.select("entity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("hour"), *r6("s", "mad"), F.when(F.col("mad") > 0, F.round("z", 4)).alias("z"), "flag")


SQL["stream_online_flags"] = f"""WITH {_H},
k AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i0,
  first_value(x IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS i1 FROM h
  WINDOW b AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT entity, idx, ts, hour(ts) AS slot, count(*) OVER (PARTITION BY entity) AS n_,
  CASE WHEN x IS NOT NULL THEN x WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (i1 - i0) * least(idx - i0, 6) END AS x FROM k),
ref AS (SELECT * FROM i WHERE idx < floor(n_ * 0.75::DOUBLE)), {_mad('sm', 'ref', 'entity, slot')},
t AS (SELECT i.entity, i.idx, i.ts, (x - med) / (mad + 1e-9) AS s FROM i LEFT JOIN sm ON sm.entity = i.entity AND sm.slot = i.slot WHERE i.idx >= floor(n_ * 0.75::DOUBLE)),
{_flagger('t', _LAG, '71 PRECEDING AND CURRENT ROW').replace('>= 84', '>= 18')}
SELECT entity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS hour, round(s, 6) AS s, round(mad, 6) AS mad, CASE WHEN mad > 0 THEN round(z, 4) END AS z, flag FROM fl WHERE ts <= (SELECT max(ts) FROM t) - INTERVAL 3 HOUR"""


def _windows(spark, sf_dir, length, stride):
    d = daily(spark, sf_dir).withColumns(C.cyclic(F.col("ts"))).withColumns({"load": F.col("x"), "temp": C.climate_proxy(F.col("ts"), F.lit(40.0))})
    d = P.scale(d, ["load", "temp"])
    cols = ["z_load", "z_temp", "dow_sin", "dow_cos"]
    return M.windows_of(d.where("span = 'train'"), cols, length, stride), M.windows_of(test_span(d), cols, length, stride)


@query
def recurrent_autoencoder(spark, sf_dir):
    train, test = _windows(spark, sf_dir, 14, 7)
    return M.score_windows(test, FT.fit_windows(train, M.RecurrentAutoencoder()))


@query
def masked_patches(spark, sf_dir):
    """Residuals of the masked patch model, each from the rows up to it."""
    train, _ = _windows(spark, sf_dir, 28, 7)
    _, test = _windows(spark, sf_dir, 28, 1)
    return M.point_residuals(test, FT.fit_windows(train, M.MaskedPatches(patch=7, stride=7)))


@query
def tuned_detectors(spark, sf_dir):
    """Micro F1 of every configuration of the grids on planted validation events, and each detector's choice."""
    d = stored(daily(spark, sf_dir), "panel")
    ev = stored(planted(d).where("start + 40 < 340"), "events")
    rows = ev.select("entity", "add", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("span_idx"), F.lit("val").alias("span"))
    d = d.join(rows, ["entity", "span", "span_idx"], "left").withColumn("x", F.col("x") + F.coalesce("add", F.lit(0.0))).drop("add").withColumns(C.cyclic(F.col("ts")))
    d = P.scale(d.withColumns({"load": F.col("x"), "temp": C.climate_proxy(F.col("ts"), F.lit(40.0))}), ["load", "temp"])
    d = stored(d.withColumns({"load": F.col("z_load"), "temp": F.col("z_temp")}).drop("z_load", "z_temp"), "tuning")
    train, val = d.where("span = 'train'"), d.where("span = 'val'").drop("idx").withColumnRenamed("span_idx", "idx")
    out = []
    for name, grid in M.GRIDS.items():
        best, got = FT.tune(train, val, ev.drop("add"), grid, M.FEATURES, 112)
        for i, (make, v) in enumerate(zip(grid, got)):
            how = vars(make())
            out.append((name, ", ".join(f"{k}={how[k]}" for k in ("trees", "sample", "nu", "gamma", "hidden") if k in how), v, i == best))
    return spark.createDataFrame(out, "detector string, configuration string, micro_f1 double, chosen boolean")
