"""More registered queries: files of panels, weather, comparisons of detectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import evaluate as E
from ..operators import fitting as FT
from ..operators import intervals as IV
from ..operators import models as M
from ..operators import panel as P
from ..operators import scoring as S
from ..operators import stats as X
from ..operators import waste as WS
from ..operators import windows as W
from ..sources import panels as SRC
from ..storage import shared_dir, stored
from . import panels
from .panels import daily, hourly, planted, table, test_span
from .queries import _D, _EV, _FL, _FUSE, _FUSED, _H, _LAG, _MT, _PROXY, _RES, SQL, Q, _boot, _flagger, _mad, _runs, _windows, metric_table, query, r6, reference, residual, scored, validation_scores


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- files


@query
def panel_files(spark, sf_dir):
    """The hourly panel as CSV files in a folder for each building, and read back with its schema."""
    h = hourly(spark, sf_dir).withColumns(C.cyclic(F.col("ts")))
    path = _folder(spark, "panel")
    SRC.write_panel(h.select(F.col("entity").alias("building_id"), F.col("ts").alias("timestamp"), F.col("x").alias("load"), F.lit(20.5).alias("temp"), F.lit("office").alias("btype"), "hour_sin", "hour_cos", "dow_sin", "dow_cos"), path, "csv")
    got = SRC.read_panel(spark, path)
    return got.select("building_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("hour"), "temp", "btype", *r6("load", "hour_sin", "hour_cos", "dow_sin", "dow_cos"))


SQL["panel_files"] = f"""WITH {_H} SELECT entity AS building_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS hour, 20.5::DOUBLE AS temp, 'office' AS btype, round(x, 6) AS load, round(sin(hour(ts) * (2 * pi() / 24)), 6) AS hour_sin, round(cos(hour(ts) * (2 * pi() / 24)), 6) AS hour_cos,
  round(sin((isodow(ts) - 1) * (2 * pi() / 7)), 6) AS dow_sin, round(cos((isodow(ts) - 1) * (2 * pi() / 7)), 6) AS dow_cos FROM h"""


@query
def pruned_scan(spark, sf_dir):
    """Two buildings of the panel files: other buildings' files and other columns are not read."""
    h, path = hourly(spark, sf_dir), _folder(spark, "panel")
    SRC.write_panel(h.select(F.col("entity").alias("building_id"), F.col("ts").alias("timestamp"), F.col("x").alias("load"), F.lit(1.0).alias("temp")), path)
    got = spark.read.parquet(path).where(F.col("building_id").isin("click", "view")).select("building_id", "load")
    return got.groupBy("building_id").agg(F.count("*").alias("n"), F.count("load").alias("n_known"), F.round(F.sum("load"), 3).alias("total"))


SQL["pruned_scan"] = f"WITH {_H} SELECT entity AS building_id, count(*) AS n, count(x) AS n_known, round(sum(x), 3) AS total FROM h WHERE entity IN ('click', 'view') GROUP BY 1"


@query
def labelled_scan(spark, sf_dir):
    """Labelled readings from a CSV file with NaN readings."""
    path = _folder(spark, "labelled")
    h = hourly(spark, sf_dir).select(F.col("entity").alias("building_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.coalesce(F.col("x").cast("string"), F.lit("nan")).alias("meter_reading"), (F.col("idx") % 50 < 4).cast("int").alias("anomaly"))
    h.write.option("header", True).csv(path)
    return SRC.read_labelled(spark, path).groupBy("entity", "anomaly").agg(F.count("*").alias("n"), F.count("x").alias("n_known"), F.round(F.sum("x"), 3).alias("total"))


SQL["labelled_scan"] = f"WITH {_H} SELECT entity, (idx % 50 < 4)::INT AS anomaly, count(*) AS n, count(x) AS n_known, round(sum(x), 3) AS total FROM h GROUP BY 1, 2"


@query
def selection_files(spark, sf_dir):
    """Selected entities as a tab-separated file without header, and read back."""
    path = _folder(spark, "selection")
    q = P.quality(hourly(spark, sf_dir)).select(F.col("entity").alias("building_id"), F.lit("hourly").alias("tag"), F.round("completeness", 6).alias("completeness"))
    SRC.write_selection(q, path)
    return SRC.read_selection(spark, path)


SQL["selection_files"] = f"WITH {_H} SELECT entity AS building_id, 'hourly' AS tag, round(avg((x IS NOT NULL)::INT::DOUBLE), 6) AS completeness FROM h GROUP BY 1"


@query
def results_by_seed(spark, sf_dir):
    """Results in a folder for each seed: a rerun of one seed replaces only its own, and the merge is a read."""
    m, path = stored(metric_table(spark, sf_dir).withColumn("v", F.round("v", 9)), "results"), _folder(spark, "results")
    SRC.write_results(m.withColumn("v", F.when(F.col("seed") == 1, -1.0).otherwise(F.col("v"))), path)
    SRC.write_results(m.where("seed = 1"), path)
    return spark.read.parquet(path).select("entity", "site", "model", F.col("seed").cast("int").alias("seed"), "v")


SQL["results_by_seed"] = f"WITH {_MT} SELECT entity, site, model, seed, round(v, 9) AS v FROM mt"


@query
def weather_join(spark, sf_dir):
    """Weather in UTC and metadata from CSV files, joined to the load by site and wall time in three zones, over the end of summer
    time: repeated hours, null and repeated readings; gaps filled, sites without readings by the proxy of their latitude."""
    base = _folder(spark, "weather")
    # the hours of the panel, from the day before clocks go back (2024-10-27 in Europe, 2024-11-03 in America)
    h = hourly(spark, sf_dir).withColumn("ts", F.expr("timestamp_ntz'2024-10-26 00:00:00' + make_dt_interval(0, cast(idx as int)) "))
    e = F.col("entity")
    site = F.when(e.isin("click", "view"), "east").when(e == "purchase", "paris").otherwise("far")
    zone = F.when(e.isin("click", "view"), "America/New_York").when(e == "purchase", "Europe/Paris").otherwise("Asia/Kolkata")
    meta = h.select("entity").distinct().select(e.alias("building_id"), F.lit("Office").alias("primaryspaceusage"), (F.length("entity") + 35.0).alias("lat"), zone.alias("timezone"), site.alias("site_id"))
    meta.write.option("header", True).csv(f"{base}/metadata")
    w = h.where("entity in ('click', 'purchase') and idx % 5 <> 0").select(F.col("ts").alias("timestamp"), F.when(e == "click", "east").otherwise("paris").alias("site_id"), F.when(F.col("idx") % 7 != 0, F.round(F.coalesce("x", F.lit(0.0)), 2) / 10).alias("airTemperature"), "idx")
    again = w.where("idx % 9 = 1").withColumn("airTemperature", F.col("airTemperature") + 1)
    w.unionByName(again).drop("idx").write.option("header", True).csv(f"{base}/weather")
    sites = SRC.read_metadata(spark, f"{base}/metadata").withColumnRenamed("building_id", "entity")
    out = P.with_weather(h, sites, SRC.read_weather(spark, f"{base}/weather"))
    return out.select("entity", "idx", "site_id", "measured", *r6("x", "temp"))


SQL["weather_join"] = f"""WITH {_H},
hh AS (SELECT entity, idx, TIMESTAMP '2024-10-26 00:00:00' + to_hours(idx::INT) AS ts, x FROM h),
s AS (SELECT entity, CASE WHEN entity IN ('click', 'view') THEN 'east' WHEN entity = 'purchase' THEN 'paris' ELSE 'far' END AS site_id, len(entity) + 35.0::DOUBLE AS lat FROM (SELECT DISTINCT entity FROM h)),
w0 AS (SELECT entity, idx, ts AS utc, CASE entity WHEN 'click' THEN 'east' ELSE 'paris' END AS site_id, CASE entity WHEN 'click' THEN 'America/New_York' ELSE 'Europe/Paris' END AS zone, CASE WHEN idx % 7 <> 0 THEN round(coalesce(x, 0), 2) / 10 END AS t
  FROM hh WHERE entity IN ('click', 'purchase') AND idx % 5 <> 0),
w1 AS (SELECT site_id, utc, timezone(zone, timezone('UTC', utc)) AS ts, t FROM w0 WHERE t IS NOT NULL),
w AS (SELECT site_id, ts, t FROM w1 QUALIFY row_number() OVER (PARTITION BY site_id, ts ORDER BY utc) = 1),
gr AS (SELECT site_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM w GROUP BY 1),
g AS (SELECT gr.site_id, gr.ts, t, row_number() OVER (PARTITION BY gr.site_id ORDER BY gr.ts) - 1 AS idx FROM gr LEFT JOIN w USING (site_id, ts)),
k AS (SELECT *, last_value(t IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN t IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i0,
  first_value(t IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN t IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS i1 FROM g
  WINDOW b AS (PARTITION BY site_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY site_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
q AS (SELECT site_id, ts, CASE WHEN t IS NOT NULL THEN t ELSE v0 + (v1 - v0) / (i1 - i0) * least(idx - i0, 6) END AS got FROM k),
z AS (SELECT site_id, min(ts) AS lo, arg_min(got, ts) AS first_, max(ts) AS hi, arg_max(got, ts) AS last_ FROM q GROUP BY 1),
m AS (SELECT hh.entity, hh.idx, hh.ts, hh.x, s.site_id, lat, coalesce(got, CASE WHEN hh.ts < lo THEN first_ WHEN hh.ts > hi THEN last_ END) AS got, least(greatest(0.3::DOUBLE * lat + 4.0::DOUBLE, 4.0::DOUBLE), 30.0::DOUBLE) AS swing
  FROM hh JOIN s USING (entity) LEFT JOIN q ON q.site_id = s.site_id AND q.ts = hh.ts LEFT JOIN z ON z.site_id = s.site_id)
SELECT entity, idx, site_id, got IS NOT NULL AS measured, round(x, 6) AS x, round(coalesce(got, 28.0::DOUBLE - 0.55::DOUBLE * lat + swing * sin((dayofyear(ts) + hour(ts) / 24.0::DOUBLE - 100) * (2 * pi() / 365.25)) + 0.15::DOUBLE * swing * sin((hour(ts) - 5) * (2 * pi() / 24))), 6) AS temp FROM m"""


# ---------------------------------------------------------------- series


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily value shipped, by return flag and line status."""
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.lit("_"), "l_linestatus").alias("entity"), "l_shipdate", "l_extendedprice")
    return P.dense(P.resample(li, "entity", "l_shipdate", "l_extendedprice", "day", "sum", 2), "1 day")


_SHIPPED = """d0 AS (SELECT l_returnflag || '_' || l_linestatus AS entity, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, round(sum(l_extendedprice), 2) AS x FROM lineitem GROUP BY 1, 2),
b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM d0), g AS (SELECT entity, s.ts FROM (SELECT DISTINCT entity FROM d0) e, (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM b) s),
p AS (SELECT entity, g.ts, x FROM g LEFT JOIN d0 USING (entity, ts))"""


@query
def complete_top(spark, sf_dir):
    """The most complete entity of each flag, of those that have values on 95 % of the days."""
    q = P.quality(_shipped(spark, sf_dir)).withColumn("site", C.site_of(F.col("entity")))
    return P.select_top(q, "site", 1).select("site", "entity", "n", *r6("completeness"), F.round("mean", 3).alias("mean"))


SQL["complete_top"] = f"""WITH {_SHIPPED}, q AS (SELECT split_part(entity, '_', 1) AS site, entity, count(*) AS n, avg((x IS NOT NULL)::INT::DOUBLE) AS completeness, avg(x) AS mean, stddev_samp(x) AS sd, max(x) AS top FROM p GROUP BY 1, 2)
SELECT site, entity, n, round(completeness, 6) AS completeness, round(mean, 3) AS mean FROM q WHERE completeness >= 0.95 AND sd > 0.05 * greatest(abs(mean), 1e-9) AND top > 0 QUALIFY row_number() OVER (PARTITION BY site ORDER BY completeness DESC, entity) = 1"""


@query
def eligible_long(spark, sf_dir):
    """Entities of at least 2000 rows, half of them known."""
    return P.eligible(_shipped(spark, sf_dir))


SQL["eligible_long"] = f"WITH {_SHIPPED} SELECT entity, count(*) AS n, count(x) AS n_known FROM p GROUP BY 1 HAVING count(*) >= 2000 AND count(x) >= 0.5 * count(*)"


@query
def degree_days(spark, sf_dir):
    """Daily sums of the load from degrees above and below two balance points."""
    h = hourly(spark, sf_dir).withColumn("load", C.degree_load(C.climate_proxy(F.col("ts"), F.lit(40.0)), 18.0, 16.0, 2.5, 1.5))
    return h.groupBy("entity", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("load"), 6).alias("load"))


SQL["degree_days"] = f"""WITH {_H}, p AS (SELECT entity, ts, {_PROXY} AS t FROM h)
SELECT entity, strftime(ts, '%Y-%m-%d') AS day, round(sum(2.5 * greatest(t - 18.0, 0) + 1.5 * greatest(16.0 - t, 0)), 6) AS load FROM p GROUP BY 1, 2"""


@query
def smoothed_load(spark, sf_dir):
    return daily(spark, sf_dir).withColumn("x", W.smoothed3()).select("entity", "idx", *r6("x"))


SQL["smoothed_load"] = f"WITH {_D} SELECT entity, idx, round(avg(x) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS x FROM d"


@query
def injected_load(spark, sf_dir):
    """The test rows with the planted increments added, in units of the train deviation."""
    d = daily(spark, sf_dir)
    ev = planted(d)
    delta = ev.select("entity", F.col("add").alias("delta"), F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("idx"))
    rows = test_span(d).join(panels.scales(d), "entity")
    return P.with_delta(rows.withColumn("x", F.col("x") / F.col("sd")), delta, F.col("sd")).select("entity", "idx", *r6("x"))


SQL["injected_load"] = f"WITH {_EV} SELECT t.entity, idx, round(t.x / sd, 6) AS x FROM t JOIN sc ON sc.entity = t.entity"


# ---------------------------------------------------------------- comparisons


@query
def leak_gain(spark, sf_dir):
    """F1 with scores of the past's statistics, and with those of the whole series, test rows included."""
    d, ev, causal, _ = scored(spark, sf_dir)
    every = reference(d).select("entity", "slot", "x").unionByName(test_span(panels.injected(d, ev)).select("entity", "slot", "x"))
    leaky = stored(W.trailing_flags(S.slot_z(test_span(panels.injected(d, ev)), every, "slot")), "flags")
    a, b = (E.detection(f, ev.drop("add")).select("entity", F.round("f1", 6).alias(n)) for f, n in ((causal, "causal_f1"), (leaky, "leaky_f1")))
    return a.join(b, "entity").withColumn("gain", F.round(F.col("leaky_f1") - F.col("causal_f1"), 6))


_LEAKY = SQL["detection_metrics"].replace("ref AS (SELECT * FROM d WHERE span <> 'test')", "ref AS (SELECT entity, slot, x FROM d WHERE span <> 'test' UNION ALL SELECT entity, slot, x FROM t)")
SQL["leak_gain"] = f"""SELECT entity, a.f1 AS causal_f1, b.f1 AS leaky_f1, round(b.f1 - a.f1, 6) AS gain FROM ({SQL['detection_metrics']}) a JOIN ({_LEAKY}) b USING (entity)"""


@query
def alarm_scales(spark, sf_dir):
    """Which scale drives the false alarms of scores fused by halves."""
    ev, z = validation_scores(spark, sf_dir)
    both = z.select("entity", "idx", F.col("s").alias("short"), "long", S.fused(0.5).alias("s"))
    return E.alarm_scales(stored(W.trailing_flags(both, window=112), "flags"), ev.drop("add"), "short", "long")


SQL["alarm_scales"] = f"""WITH {_FUSE}, y AS (SELECT entity, idx, s1, s2, ({dict(_FUSED)['0.5']})::DOUBLE AS s FROM z1), {_flagger('y', _LAG, '111 PRECEDING AND CURRENT ROW', 'g').replace('>= 84', '>= 28')}, {_runs('g', 'n')},
f AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.entity = n.entity AND n."start" < ev."end" AND ev."start" < n."end")),
m AS (SELECT f.entity, f."start", avg(s1) >= avg(s2) AS short FROM f JOIN y ON y.entity = f.entity AND y.idx >= f."start" AND y.idx < f."end" GROUP BY 1, 2)
SELECT entity, count(*) AS n, count(*) FILTER (short) AS short_driven FROM m GROUP BY 1"""


@query
def recall_waste(spark, sf_dir):
    """How range recall goes with the error of the estimated excess, over entities that have both."""
    d, ev, _, fl = scored(spark, sf_dir)
    a = E.detection(fl, ev.drop("add")).select("entity", *r6("range_recall"))
    b = WS.decomposition(residual(d, ev), fl, ev.drop("add")).select("entity", *[F.round(c, 4).alias(c) for c in ("delta_kwh", "missed_kwh")])
    both = a.join(b, "entity").withColumn("all", F.lit("all"))
    out = X.correlation(both, "range_recall", "missed_kwh", ["all"])
    return out.select("n", *r6("pearson", "spearman"), F.round("slope", 4).alias("slope"))


SQL["recall_waste"] = f"""WITH b AS (SELECT range_recall, missed_kwh FROM ({SQL['detection_metrics']}) JOIN ({SQL['waste_ops']}) USING (entity)),
r AS (SELECT *, rank() OVER (ORDER BY range_recall) + (count(*) OVER (PARTITION BY range_recall) - 1) / 2 AS rx, rank() OVER (ORDER BY missed_kwh) + (count(*) OVER (PARTITION BY missed_kwh) - 1) / 2 AS ry FROM b)
SELECT count(*) AS n, CASE WHEN stddev_pop(range_recall) > 0 AND stddev_pop(missed_kwh) > 0 THEN round(corr(range_recall, missed_kwh), 6) END AS pearson,
  CASE WHEN stddev_pop(range_recall) > 0 AND stddev_pop(missed_kwh) > 0 THEN round(corr(rx, ry), 6) END AS spearman, CASE WHEN stddev_pop(range_recall) > 0 THEN round(regr_slope(missed_kwh, range_recall), 4) END AS slope FROM r"""


@query
def older_waste_errors(spark, sf_dir):
    d = daily(spark, sf_dir)
    ev = planted(d).drop("add")
    rows = IV.rows_in(residual(d, planted(d)), ev)
    est = rows.groupBy("entity", "event_id", "true_kwh").agg(F.sum(WS.clipped()).alias("est"))
    return WS.relative_errors(est).select("entity", *[F.round(c, 4).alias(c) for c in ("waste_est_kwh", "waste_true_kwh", "waste_error_mean", "waste_error_total")])


SQL["older_waste_errors"] = f"""WITH {_EV}{_RES}, o AS (SELECT ev.entity, event_id, any_value(true_kwh) AS t, sum(greatest(coalesce(resid, 0), 0)) AS e FROM ev LEFT JOIN res ON ev.entity = res.entity AND res.idx >= ev."start" AND res.idx < ev."end" GROUP BY 1, 2),
g AS (SELECT entity, sum(e) AS se, sum(t) AS st, avg(abs(e - t) / greatest(t, 1e-6)) AS m FROM o GROUP BY 1)
SELECT entity, round(se, 4) AS waste_est_kwh, round(st, 4) AS waste_true_kwh, round(m, 4) AS waste_error_mean, round(abs(se - st) / greatest(st, 1e-6), 4) AS waste_error_total FROM g"""


def _long_intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hourly flags, and overlapping intervals of 1 to 8,000 hours."""
    h = hourly(spark, sf_dir)
    flags = h.select("entity", "idx", (F.col("x").isNotNull() & (F.col("idx") * 7 % 11 < 4)).alias("flag"))
    length = 1 + F.col("idx") * F.col("idx") * 31 % 8000
    return flags, h.where("idx % 29 = 0").select("entity", F.col("idx").alias("event_id"), F.col("idx").alias("start"), (F.col("idx") + length).alias("end"))


_LONG_INTERVALS = f"""{_H}, fl AS (SELECT entity, idx, x IS NOT NULL AND idx * 7 % 11 < 4 AS flag FROM h),
iv AS (SELECT entity, idx AS event_id, idx AS "start", idx + 1 + idx * idx * 31 % 8000 AS "end" FROM h WHERE idx % 29 = 0)"""


@query
def interval_hits(spark, sf_dir):
    """What flags each of many long, overlapping intervals holds."""
    flags, iv = _long_intervals(spark, sf_dir)
    return E.event_detail(flags, iv).select("entity", "event_id", "duration", "detected", "delay", F.round("range_cov", 9).alias("range_cov"))


SQL["interval_hits"] = f"""WITH {_LONG_INTERVALS}
SELECT iv.entity, event_id, any_value("end" - "start") AS duration, count(idx) > 0 AS detected, min(idx) - any_value("start") AS delay, round(count(idx) / any_value("end" - "start")::DOUBLE, 9) AS range_cov
FROM iv LEFT JOIN fl ON fl.entity = iv.entity AND flag AND idx >= "start" AND idx < "end" GROUP BY 1, 2"""


@query
def interval_overlaps(spark, sf_dir):
    """Of each run of flags, how many hours some long interval (every third of them) holds; and of each entity, the hours that none does."""
    flags, iv = _long_intervals(spark, sf_dir)
    some = iv.where("event_id % 3 = 2")
    free = IV.rows_in(flags, some, "left_anti").groupBy("entity").agg(F.count("*").alias("free"))
    return IV.shared_rows(W.runs(flags, gap=2), some).join(free, "entity", "left").select("entity", "start", "end", "shared", F.coalesce("free", F.lit(0)).alias("free"))


SQL["interval_overlaps"] = f"""WITH {_LONG_INTERVALS}, {_runs('fl', 'rn', 2)},
inside AS (SELECT entity, idx FROM h WHERE EXISTS (SELECT 1 FROM iv WHERE iv.entity = h.entity AND event_id % 3 = 2 AND h.idx >= iv."start" AND h.idx < iv."end")),
free AS (SELECT entity, count(*) AS free FROM h ANTI JOIN inside USING (entity, idx) GROUP BY 1)
SELECT rn.entity, rn."start", rn."end", (SELECT count(*) FROM inside i WHERE i.entity = rn.entity AND i.idx >= rn."start" AND i.idx < rn."end") AS shared, coalesce(free, 0) AS free FROM rn LEFT JOIN free ON free.entity = rn.entity"""


def _strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m0 less the best of the other models (by mean, then name), for entities that have both."""
    mt = metric_table(spark, sf_dir)
    best = X.best(mt.where("model <> 'm0'").groupBy("model").agg(F.round(F.avg("v"), 12).alias("mean")), [], "mean", ["model"]).select("model")
    per = mt.groupBy("entity", "model").agg(F.avg("v").alias("v"))
    other = per.join(F.broadcast(best), "model").select("entity", F.col("model").alias("contrast"), F.col("v").alias("w"))  # one row
    return per.where("model = 'm0'").join(other, "entity").select("entity", F.lit("strongest").alias("family"), "contrast", (F.col("v") - F.col("w")).alias("d"))


@query
def strongest_baseline(spark, sf_dir):
    """Paired t, signed ranks and a bootstrap over entities of the difference to the strongest other model."""
    d, keys = _strongest(spark, sf_dir), ["family", "contrast"]
    rank = X.signed_rank(d.withColumn("d", F.round("d", 9)), keys).select(*keys, "w_plus")
    return X.moments(d, keys).join(rank, keys).join(X.bootstrap(d, keys), keys).select("contrast", "n", "wins", "w_plus", *[F.round(c, 8).alias(c) for c in ("estimate", "boot_lo", "boot_hi")], *r6("t"))


_METRICS = _MT.partition(",\ncells AS")[0]
_STRONGEST = f"""WITH {_METRICS},
st AS (SELECT model FROM mt WHERE model <> 'm0' GROUP BY 1 ORDER BY round(avg(v), 12) DESC, model LIMIT 1), c AS (SELECT entity, model, avg(v) AS v FROM mt GROUP BY 1, 2),
fx AS (SELECT a.entity, 'strongest' AS family, b.model AS contrast, a.v - b.v AS d FROM c a JOIN c b ON a.entity = b.entity WHERE a.model = 'm0' AND b.model = (SELECT model FROM st))"""
SQL["strongest_baseline"] = f"""{_STRONGEST}, {_boot('entity', 'be')},
x AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS rk FROM (SELECT round(d, 9) AS d FROM fx) WHERE d <> 0)
SELECT any_value(fx.contrast) AS contrast, count(*) AS n, count(*) FILTER (fx.d > 0) AS wins, (SELECT coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE FROM x) AS w_plus, round(avg(fx.d), 8) AS estimate,
  round(any_value(be.lo), 8) AS boot_lo, round(any_value(be.hi), 8) AS boot_hi, round(avg(fx.d) / (stddev_samp(fx.d) / sqrt(count(*))), 6) AS t FROM fx, be"""


@query
def transfer_intervals(spark, sf_dir):
    """Means on seen and on unseen sites, each with an interval over resampled entities."""
    seen = F.when(F.col("site").isin("s0", "s1", "s2"), "seen").otherwise("unseen")
    d = metric_table(spark, sf_dir).groupBy(F.col("model").alias("family"), seen.alias("contrast"), "entity").agg(F.avg("v").alias("d"))
    keys = ["family", "contrast"]
    return X.moments(d, keys).select(*keys, "n", "estimate").join(X.bootstrap(d, keys, n=4000), keys).select(F.col("family").alias("model"), F.col("contrast").alias("sites"), "n", *[F.round(c, 8).alias(c) for c in ("estimate", "boot_lo", "boot_hi")])


SQL["transfer_intervals"] = f"""WITH {_METRICS},
fx AS (SELECT model AS family, CASE WHEN site IN ('s0', 's1', 's2') THEN 'seen' ELSE 'unseen' END AS contrast, entity, avg(v) AS d FROM mt GROUP BY 1, 2, 3), {_boot('entity', 'be', 4000)},
m AS (SELECT family, contrast, count(*) AS n, avg(d) AS estimate FROM fx GROUP BY 1, 2)
SELECT family AS model, contrast AS sites, n, round(estimate, 8) AS estimate, round(lo, 8) AS boot_lo, round(hi, 8) AS boot_hi FROM m JOIN be USING (family, contrast)"""


@query
def seed_effects(spark, sf_dir):
    """The difference of two models over entities, for each seed and for the entities' means of all."""
    mt = metric_table(spark, sf_dir).where("model in ('m0', 'm1')")
    each = mt.select("entity", "model", F.col("seed").cast("string").alias("seed"), "v")
    every = mt.groupBy("entity", "model").agg(F.avg("v").alias("v")).withColumn("seed", F.lit("all"))
    both = each.unionByName(every).groupBy("entity", "seed").agg(*[F.avg(F.when(F.col("model") == m, F.col("v"))).alias(m) for m in ("m0", "m1")]).withColumn("d", F.col("m0") - F.col("m1")).where("d is not null")
    mean = both.groupBy("seed").agg(F.avg("m0").alias("mean"))
    return X.moments(both, ["seed"]).join(mean, "seed").select("seed", "n", *[F.round(c, 9).alias(c) for c in ("mean", "estimate", "sd")], *r6("t"))


SQL["seed_effects"] = f"""WITH {_METRICS},
e AS (SELECT entity, model, seed::VARCHAR AS seed, v FROM mt WHERE model IN ('m0', 'm1') UNION ALL SELECT entity, model, 'all', avg(v) FROM mt WHERE model IN ('m0', 'm1') GROUP BY 1, 2),
b AS (SELECT entity, seed, avg(v) FILTER (model = 'm0') AS m0, avg(v) FILTER (model = 'm1') AS m1 FROM e GROUP BY 1, 2 HAVING m0 IS NOT NULL AND m1 IS NOT NULL)
SELECT seed, count(*) AS n, round(avg(m0), 9) AS mean, round(avg(m0 - m1), 9) AS estimate, round(stddev_samp(m0 - m1), 9) AS sd, round(avg(m0 - m1) / (stddev_samp(m0 - m1) / sqrt(count(*))), 6) AS t FROM b GROUP BY 1"""


@query
def temperature_detector(spark, sf_dir):
    """Alarms of the temperature regression: residuals over 3.5 MADs of its train rows' (fitted on 70 % of
    the series, scored on the rest)."""
    d = daily(spark, sf_dir).withColumn("temp", C.climate_proxy(F.col("ts"), F.lit(40.0)))
    n = F.count("*").over(Window.partitionBy("entity"))
    d = d.withColumn("train", F.col("idx") < F.floor(n * F.lit(0.7)))
    r = S.towt_residual(d, F.col("train"))
    st = S.median_mad(r.where("train"), ["entity"], "r").select("entity", "med", "mad")
    z = r.where("not train").join(st, "entity").withColumn("z", F.abs(F.col("r") - F.col("med")) / (F.col("mad") + 1e-9))
    return z.groupBy("entity").agg(F.count("*").alias("n"), F.count(F.when(F.col("z") > 3.5, 1)).alias("alarms"))


SQL["temperature_detector"] = f"""WITH {_D}, e AS (SELECT *, {_PROXY} AS t1 FROM d), f AS (SELECT *, t1 * t1 AS t2, idx < floor(count(*) OVER (PARTITION BY entity) * 0.7::DOUBLE) AS train FROM e),
m AS (SELECT entity, slot, avg(t1) AS a, avg(t2) AS b, avg(x) AS y FROM f WHERE train GROUP BY 1, 2),
c AS (SELECT f.entity, idx, train, t1 - a AS a, t2 - b AS b, x - y AS v FROM f LEFT JOIN m ON m.entity = f.entity AND m.slot = f.slot),
s AS (SELECT entity, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * v) AS av, sum(b * v) AS bv FROM c WHERE train GROUP BY 1),
r AS (SELECT c.entity, train, v - (av * bb - bv * ab) / (aa * bb - ab * ab) * a - (bv * aa - av * ab) / (aa * bb - ab * ab) * b AS r FROM c JOIN s ON s.entity = c.entity),
rt AS (SELECT * FROM r WHERE train), {_mad('rm', 'rt', 'entity', 'r')}
SELECT r.entity, count(*) AS n, count(*) FILTER (abs(r - med) / (mad + 1e-9) > 3.5) AS alarms FROM r JOIN rm ON rm.entity = r.entity WHERE NOT train GROUP BY 1"""


# ---------------------------------------------------------------- without SQL: fits


@query
def masked_variants(spark, sf_dir):
    """Residuals of the masked patch model under other masks: some patches hidden in training, only the
    judged row's patches hidden, none hidden, residuals pooled over windows, and the load by itself."""
    train, _ = _windows(spark, sf_dir, 28, 7)
    _, test = _windows(spark, sf_dir, 28, 1)
    full, some = (FT.fit_windows(train, M.MaskedPatches(patch=7, stride=7, hide=h)) for h in (1.0, 0.4))
    alone = [w.select("entity", "start", F.transform("values", lambda r: F.array(r[0], F.lit(0.0))).alias("values")) for w in (train, test)]
    own = FT.fit_windows(alone[0], M.MaskedPatches(patch=7, stride=7, hide=0.4))
    parts = {
        "full mask, last row": M.point_residuals(test, full),
        "full mask, pooled": M.score_windows(test, full, "avg", signed=True),
        "patch mask, last row": M.point_residuals(test, some),
        "target mask, last row": M.point_residuals(test, some, some.target_residuals),
        "no mask, last row": M.point_residuals(test, some, some.open_residuals),
        "load alone, target mask": M.point_residuals(alone[1], own, own.target_residuals),
    }
    out = None
    for name, r in parts.items():
        r = r.select(F.lit(name).alias("variant"), "entity", "idx", "x")
        out = r if out is None else out.unionByName(r)
    return out


@query
def channel_patches(spark, sf_dir):
    """Residuals of the last rows of windows by the model with a token for each patch and channel, their own patches
    hidden: channels mixed, and each by itself."""
    train, _ = _windows(spark, sf_dir, 28, 7)
    _, test = _windows(spark, sf_dir, 28, 1)
    out = None
    for name, mix in (("mixed", True), ("alone", False)):
        m = FT.fit_windows(train, M.ChannelPatches(patch=7, stride=7, mix=mix))
        r = M.point_residuals(test, m, m.target_residuals).select(F.lit(name).alias("channels"), "entity", "idx", "x")
        out = r if out is None else out.unionByName(r)
    return out


@query
def network_alarms(spark, sf_dir):
    """Residuals of the dense autoencoder, scored by slot like any others, fused and flagged; with the measured
    temperature replaced by the proxy (``swapped``) and without."""
    base = daily(spark, sf_dir).withColumns(C.cyclic(F.col("ts")))
    warm = base.withColumn("temp", F.col("idx") % 30 + C.climate_proxy(F.col("ts"), F.lit(40.0)))
    out = None
    for name, d in (("measured", warm), ("swapped", base.withColumn("temp", C.climate_proxy(F.col("ts"), F.lit(40.0))))):
        d = P.scale(d.withColumn("load", F.col("x")), ["load", "temp"])
        d = stored(d.withColumns({"load": F.col("z_load"), "temp": F.col("z_temp")}).drop("z_load", "z_temp"), "features")
        r = stored(M.score(d, FT.fit(d.where("span = 'train'"), M.Autoencoder()), out="r").select("entity", "idx", "span", "span_idx", "slot", F.col("r").alias("x")), "residuals")
        test, tr = r.where("span = 'test'").drop("idx").withColumnRenamed("span_idx", "idx"), r.where("span = 'train'")
        z = S.long_z(S.slot_z(test, tr, "slot"), tr, window=28, least=7)
        fl = W.trailing_flags(z.withColumn("s", S.fused(0.8)), window=112)
        one = fl.groupBy("entity").agg(F.count("*").alias("n"), F.count(F.when(F.col("flag"), 1)).alias("alarms")).withColumn("weather", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
