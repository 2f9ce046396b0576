"""Queries of fault injection: six events an entity in the test span, scales of the train span, and what a detector finds of them.
The SQL replays the sampler: draws are hashes, and acceptance is a recursive statement over their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import aggregate as A
from ..operators import evaluate as E
from ..operators import inject as I
from ..operators import panel as P
from ..operators import scoring as S
from ..operators import windows as W
from ..storage import stored
from .panels import hourly, test_span
from .queries import _H, _LAG, _U, SQL, _flagger, _mad, query, r6, reference

#: The events table has a month of hours: half of it is the test span, so that the longest event (13 days) has room.
TRAIN, VAL, SEED, WINDOW, LEAST = 0.4, 0.1, 123, 72, 10


def month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly panel of the events, gaps filled, split 40 / 10 / 50."""
    return P.split(P.interpolated(hourly(spark, sf_dir)).withColumn("slot", C.hour_slot(F.col("ts"))), TRAIN, VAL)


_P = f"""{_H},
pk AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i0,
  first_value(x IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS i1 FROM h
  WINDOW b AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
pf AS (SELECT entity, idx, hour(ts) AS slot, count(*) OVER (PARTITION BY entity) AS n_,
  CASE WHEN x IS NOT NULL THEN x WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (i1 - i0) * least(idx - i0, 6) END AS x FROM pk),
ref AS (SELECT *, idx < floor(n_ * {TRAIN}::DOUBLE) AS train, slot >= 8 AND slot < 18 AS works FROM pf WHERE idx < floor(n_ * ({TRAIN}::DOUBLE + {VAL}::DOUBLE))),
te AS (SELECT entity, slot, x, idx - floor(n_ * ({TRAIN}::DOUBLE + {VAL}::DOUBLE))::BIGINT AS idx FROM pf WHERE idx >= floor(n_ * ({TRAIN}::DOUBLE + {VAL}::DOUBLE))),
sc AS (SELECT entity, stddev_pop(x) FILTER (train) AS sigma, median(x) FILTER (train) AS med,
  greatest(avg(x) FILTER (train AND works) - avg(x) FILTER (train AND NOT works), 0) AS night FROM ref GROUP BY 1),
sn AS (SELECT sc.*, n FROM sc JOIN (SELECT entity, count(*) AS n FROM te GROUP BY 1) USING (entity))"""


def _draw(what: str) -> str:
    return _U.format(f"'{SEED}|' || entity || '|' || k || '|{what}'")


def _range(lo_hi: list[tuple[float, float]], at: str, u: str) -> str:
    lo, hi = (f"[{', '.join(f'{r[i]}::DOUBLE' for r in lo_hi)}][{at}]" for i in (0, 1))
    return f"({lo} + {u} * ({hi} - {lo}))"


def _sampler(additive: bool = False, to: str = "") -> str:
    """SQL of the draws (dw) and of the accepted events (ej) and their increments (ei); names end in ``to``."""
    lift = "strength * night" if additive else "greatest(med * strength - x, 0)"
    return f"""d1{to} AS (SELECT sn.*, k::INT AS k, floor({_draw('type')} * 3)::INT + 1 AS kind, floor({_draw('severity')} * 3)::INT + 1 AS severity FROM sn, range({I.MOST_DRAWS}) AS r(k)),
d2{to} AS (SELECT *, floor({_range([I.LENGTH[x] for x in I.KINDS], 'kind', _draw('length'))})::INT * CASE WHEN kind = 1 THEN 1 ELSE 24 END AS hours,
  {_range([I.STRENGTH[x][s] for x in I.KINDS for s in (1, 2, 3)], '(kind - 1) * 3 + severity', _draw('strength'))} AS strength FROM d1{to}),
d3{to} AS (SELECT *, floor({_draw('start')} * (n - hours - 1))::BIGINT AS s FROM d2{to}),
sl{to} AS (SELECT d.entity, k, t.idx - s AS j, CASE WHEN slot >= 8 AND slot < 18 THEN 0 ELSE {lift} END AS v FROM d3{to} d JOIN te t ON t.entity = d.entity AND t.idx >= s AND t.idx < s + hours WHERE kind = 3),
sm{to} AS (SELECT entity, k, j, avg(v) OVER (PARTITION BY entity, k ORDER BY j ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM sl{to}),
d4{to} AS MATERIALIZED (SELECT d.*, CASE kind WHEN 1 THEN strength * sigma WHEN 2 THEN strength / 24 * hours * med ELSE top END AS peak
  FROM d3{to} d LEFT JOIN (SELECT entity, k, max(a) AS top FROM sm{to} GROUP BY 1, 2) m ON m.entity = d.entity AND m.k = d.k),
rc{to} AS (SELECT entity, -1 AS k, 0 AS kind, 0 AS severity, 0::BIGINT AS s, 0::BIGINT AS e, NULL::VARCHAR AS reason, []::STRUCT(s BIGINT, e BIGINT)[] AS got FROM sn
  UNION ALL SELECT entity, k, kind, severity, s, s + hours, why, CASE WHEN why = '' THEN list_append(got, {{'s': s, 'e': s + hours}}) ELSE got END FROM (
    SELECT d.*, r.got, CASE WHEN d.n - d.hours - 1 <= 0 THEN '{I.NO_ROOM}' WHEN EXISTS (SELECT 1 FROM (SELECT unnest(r.got) AS g) WHERE d.s < g.e AND g.s < d.s + d.hours) THEN '{I.CLASH}'
      WHEN d.peak >= {I.LEAST_PEAK} THEN '' ELSE '{I.WEAK}' END AS why FROM rc{to} r JOIN d4{to} d ON d.entity = r.entity AND d.k = r.k + 1 WHERE len(r.got) < 6)),
dw{to} AS (SELECT * FROM rc{to} WHERE k >= 0),
ej{to} AS (SELECT d.*, row_number() OVER (PARTITION BY d.entity ORDER BY d.k)::INT - 1 AS event_id FROM d4{to} d JOIN dw{to} w ON w.entity = d.entity AND w.k = d.k WHERE w.reason = ''),
ei{to} AS (SELECT e.entity, event_id, s + i AS idx, CASE kind WHEN 1 THEN strength * sigma * CASE WHEN hours = 1 THEN 1 ELSE (0.5 - 0.5 * cos(2 * pi() * i / (2 * hours - 1))) / (0.5 - 0.5 * cos(2 * pi() * (hours - 1) / (2 * hours - 1))) END
  WHEN 2 THEN strength / 24 * hours * med * i / (hours - 1) ELSE a END AS a FROM ej{to} e JOIN range(24 * 14) AS r(i) ON i < hours LEFT JOIN sm{to} m ON m.entity = e.entity AND m.k = e.k AND m.j = i),
ev{to} AS (SELECT e.entity, e.event_id, s AS "start", s + hours AS "end", ['spike', 'drift', 'schedule'][kind] AS type, severity, ['subtle', 'moderate', 'obvious'][severity] AS severity_name, t.kwh AS true_kwh
  FROM ej{to} e JOIN (SELECT entity, event_id, sum(greatest(a, 0)) AS kwh FROM ei{to} GROUP BY 1, 2) t ON t.entity = e.entity AND t.event_id = e.event_id)"""


@query
def injected_events(spark, sf_dir):
    return I.inject(month(spark, sf_dir), seed=SEED)[0].select("entity", "event_id", "start", "end", "type", "severity", "severity_name", *r6("true_kwh"))


SQL["injected_events"] = f'WITH RECURSIVE {_P}, {_sampler()} SELECT entity, event_id, "start", "end", type, severity, severity_name, round(true_kwh, 6) AS true_kwh FROM ev'


@query
def injection_draws(spark, sf_dir):
    """Draws by entity, type and severity: all, accepted, and refused by reason."""
    return A.draw_counts(I.inject(month(spark, sf_dir), seed=SEED)[2], ["entity", "type", "severity"])


SQL["injection_draws"] = f"""WITH RECURSIVE {_P}, {_sampler()} SELECT entity, ['spike', 'drift', 'schedule'][kind] AS type, severity, count(*) AS draws, count(*) FILTER (reason = '') AS accepted,
  count(*) FILTER (reason = '{I.CLASH}') AS overlap, count(*) FILTER (reason = '{I.WEAK}') AS weak FROM dw GROUP BY ALL"""


def _found(panel: DataFrame, additive: bool) -> DataFrame:
    """Detail of the injected events under the slot detector."""
    events, delta, _ = I.inject(panel, seed=SEED, additive=additive)
    t = P.with_delta(test_span(panel), delta)
    return E.event_detail(W.trailing_flags(S.slot_z(t, reference(panel), "slot", least=LEAST), window=WINDOW), events)


def _found_sql(additive: bool = False, to: str = "") -> str:
    return f"""{_sampler(additive, to)},
ti{to} AS (SELECT te.entity, te.idx, slot, x + coalesce(a, 0) AS x FROM te LEFT JOIN ei{to} e ON e.entity = te.entity AND e.idx = te.idx),
z{to} AS (SELECT t.*, (t.x - CASE WHEN ms.n >= {LEAST} THEN ms.med ELSE mp.med END) / (CASE WHEN ms.n >= {LEAST} THEN ms.mad ELSE mp.mad END + 1e-9) AS s
  FROM ti{to} t JOIN mp ON mp.entity = t.entity LEFT JOIN ms ON ms.entity = t.entity AND ms.slot = t.slot),
{_flagger(f'z{to}', _LAG, f'{WINDOW - 1} PRECEDING AND CURRENT ROW', f'fl{to}').replace('>= 84', f'>= {WINDOW // 4}')},
fd{to} AS (SELECT v.entity, v.event_id, any_value(type) AS type, any_value(severity) AS severity, coalesce(bool_or(flag), false) AS detected, min(f.idx) FILTER (flag) - any_value(v."start") AS delay
  FROM ev{to} v JOIN fl{to} f ON f.entity = v.entity AND f.idx >= v."start" AND f.idx < v."end" GROUP BY 1, 2)"""


_REF = f"{_P}, {_mad('mp', 'ref', 'entity')}, {_mad('ms', 'ref', 'entity, slot')}"


@query
def injected_recall(spark, sf_dir):
    """Recall by type and severity of the sampler's events, with totals."""
    detail = _found(stored(month(spark, sf_dir), "month"), False)
    every = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    return E.recall_by(detail, "type", "severity", total=True).select(every("type"), every("severity"), "n", *r6("recall", "delay"))


SQL["injected_recall"] = f"""WITH RECURSIVE {_REF}, {_found_sql()} SELECT coalesce(type, 'all') AS type, coalesce(severity::VARCHAR, 'all') AS severity, count(*) AS n, round(avg(detected::INT), 6) AS recall, round(avg(delay), 6) AS delay
FROM fd GROUP BY ROLLUP (type, severity)"""


@query
def additive_schedules(spark, sf_dir):
    """Recall by type when off-hours are lifted by a share of the day-night difference, and when up to a level."""
    p = stored(month(spark, sf_dir), "month")
    one = lambda name, additive: E.recall_by(_found(p, additive), "type").select(F.lit(name).alias("schedule"), "type", "n", *r6("recall", "delay"))
    return one("level", False).unionByName(one("additive", True))


SQL["additive_schedules"] = f"""WITH RECURSIVE {_REF}, {_found_sql()}, {_found_sql(True, '_x')}
SELECT schedule, type, count(*) AS n, round(avg(detected::INT), 6) AS recall, round(avg(delay), 6) AS delay FROM (SELECT 'level' AS schedule, * FROM fd UNION ALL SELECT 'additive', * FROM fd_x) GROUP BY 1, 2"""
