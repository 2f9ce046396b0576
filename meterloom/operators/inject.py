"""Fault injection: accepted events and the increments they add.

A draw is a number: its type, severity, length, place and strength are hashes of (seed, entity, number, what), so a rerun
agrees, whatever the partitions, and SQL can replay it. Only acceptance depends on the draws before (events don't overlap), which
is a fold over an entity's numbers. An entity is one row that holds the loads of its span (a year of hours at most,
some 70 KB); one shuffle brings it together, and nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import hash01
from ..functions.special import let

# Types, names of severities, ranges of strength by severity (standard deviations; share of the median a day; share of
# the median or of the day-night difference), and of length (hours; days; days), the upper end left out; working hours, the least
# peak, the most draws, and the reasons that a draw is refused for.
KINDS = ("spike", "drift", "schedule")
NAMES = {1: "subtle", 2: "moderate", 3: "obvious"}
STRENGTH = {
    "spike": {1: (3.0, 4.5), 2: (5.0, 7.0), 3: (8.0, 10.0)},
    "drift": {1: (0.02, 0.04), 2: (0.06, 0.09), 3: (0.12, 0.15)},
    "schedule": {1: (0.30, 0.50), 2: (0.55, 0.75), 3: (0.85, 1.00)},
}
LENGTH = {"spike": (1, 6), "drift": (5, 14), "schedule": (3, 10)}
ON_HOURS, LEAST_PEAK, MOST_DRAWS = (8, 18), 0.5, 1000
CLASH, WEAK = "overlap", "peak<0.5kW"
#: Not of the original: the span is shorter than the event drawn.
NO_ROOM = "no room"

EVENTS = ("entity", "event_id", "start", "end", "type", "severity", "severity_name", "true_kwh")
DRAWS = ("entity", "draw", "type", "severity", "accepted", "reason")
_FOLDED = "array<struct<draw:int,kind:int,severity:int,start:bigint,end:bigint,reason:string,add:array<double>>>"


def pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at)


def working(hour: Column) -> Column:
    return (hour >= ON_HOURS[0]) & (hour < ON_HOURS[1])


def mean(a: Column) -> Column:
    """The mean of an array; null of an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(a), F.lit(0))


def mean3(a: Column) -> Column:
    """Centred three-point means of an array, of two points at the ends."""
    near = lambda i: F.filter(F.array(F.get(a, i - 1), F.get(a, i), F.get(a, i + 1)), lambda v: v.isNotNull())
    return F.transform(a, lambda _, i: let(near(i), mean))


def spike(hours: Column, top: Column) -> Column:
    """The rising half of a Hann window of twice the length, its last hour at ``top``; flat for one hour."""
    rise = lambda i: 0.5 - 0.5 * F.cos(2 * F.pi() * i / (2 * hours - 1))
    hour = F.sequence(F.lit(0), hours - 1)
    return F.transform(hour, lambda i: F.when(hours == 1, top).otherwise(top * rise(i) / rise(hours - 1)))


def drift(hours: Column, last: Column) -> Column:
    """A straight rise from 0 to ``last``."""
    return F.transform(F.sequence(F.lit(0), hours - 1), lambda i: last * i / (hours - 1))


def schedule(rows: Column, lift: Callable[[Column], Column]) -> Column:
    """``lift`` of the load outside working hours, smoothed."""
    return let(F.transform(rows, lambda r: F.when(working(r["hour"]), 0.0).otherwise(lift(r["x"]))), mean3)


def drawn(seed: int, k: Column) -> Column:
    """The draw of number k: (draw, kind from 1, severity, hours, strength, place in [0, 1))."""
    u = lambda k, what: hash01(F.lit(seed), F.col("entity"), k, F.lit(what))
    first = F.struct(k.alias("draw"), (F.floor(u(k, "type") * 3) + 1).cast("int").alias("kind"), (F.floor(u(k, "severity") * 3) + 1).cast("int").alias("severity"))

    def sized(d: Column) -> Column:
        lo, hi = (pick([LENGTH[k][i] for k in KINDS], d["kind"]) for i in (0, 1))
        unit = F.when(d["kind"] == 1, 1).otherwise(24)
        weak, strong = (pick([STRENGTH[k][s][i] for k in KINDS for s in (1, 2, 3)], (d["kind"] - 1) * 3 + d["severity"]) for i in (0, 1))
        return F.struct(
            d["draw"].alias("draw"), d["kind"].alias("kind"), d["severity"].alias("severity"), ((F.floor(lo + u(d["draw"], "length") * (hi - lo))) * unit).cast("int").alias("hours"),
            (weak + u(d["draw"], "strength") * (strong - weak)).alias("strength"), u(d["draw"], "start").alias("place"),
        )

    return let(first, sized)


def sampled(panel: DataFrame, n_events: int = 6, seed: int = 123, span: str = "test", ref: str | None = "train", additive: bool = False, least_share: float | None = None) -> DataFrame:
    """(entity, draw, kind, severity, start, end, reason, add): what each entity's sampler drew, in order, until it had ``n_events`` events
    or drew ``MOST_DRAWS`` times; an accepted draw has no reason and the increments of its rows.

    panel: (entity, idx, ts, x, span). Scales (deviation, median, day-night difference) are those of ``ref``; without it they are
    the span's own, and the median is that of the loads with the events accepted so far. ``additive``: schedules lift by a share of the
    day-night difference instead of to a share of the median. ``least_share``: the least peak as a share of the median, not LEAST_PEAK.
    A row without load is not lifted to a level; an entity without rows in ``ref`` gets no event."""
    if additive and ref is None:
        raise ValueError("additive schedules need a reference span")
    base, row = F.col("span") == (ref or span), F.struct("idx", "x", F.hour("ts").alias("hour"))
    ordered = lambda c: F.sort_array(F.collect_list(F.when(c, row)))
    one = panel.groupBy("entity").agg(ordered(F.col("span") == span).alias("rows"), ordered(base & F.col("x").isNotNull()).alias("base"), F.median(F.when(base, F.col("x"))).alias("med"))
    # sums in the rows' order, so that the last bits don't depend on partitions
    loads = lambda c: F.transform(F.filter("base", c), lambda r: r["x"])
    day, night = mean(loads(lambda r: working(r["hour"]))), mean(loads(lambda r: ~working(r["hour"])))
    sigma = let(mean(loads(lambda r: F.lit(True))), lambda m: F.sqrt(mean(F.transform(loads(lambda r: F.lit(True)), lambda v: (v - m) * (v - m)))))
    one = one.where(F.size("rows") > 0)
    scales = F.struct("med", sigma.alias("sigma"), F.greatest(day - night, F.lit(0.0)).alias("night"))
    n, least = F.size("rows"), F.lit(LEAST_PEAK) if least_share is None else least_share * F.col("med")
    accepted = lambda acc: F.filter(acc, lambda e: e["reason"] == "")

    def level(acc: Column) -> Column:
        if ref is not None:
            return F.col("med")
        gain = lambda i: F.aggregate(accepted(acc), F.lit(0.0), lambda s, e: s + F.when((i >= e["start"]) & (i < e["end"]), F.get(e["add"], (i - e["start"]).cast("int"))).otherwise(0.0))
        loads = F.sort_array(F.filter(F.transform("rows", lambda r, i: r["x"] + gain(i)), lambda v: v.isNotNull()))
        return let(loads, lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2)

    def increments(sc: Column, acc: Column, d: Column, start: Column) -> Column:
        own = F.slice("rows", start.cast("int") + 1, d["hours"])
        lift = (lambda _: d["strength"] * sc["night"]) if additive else None
        calm = schedule(own, lift) if additive else let(level(acc) * d["strength"], lambda goal: schedule(own, lambda v: F.greatest(F.coalesce(goal - v, F.lit(0.0)), F.lit(0.0))))
        return F.when(d["kind"] == 1, spike(d["hours"], d["strength"] * sc["sigma"])).when(d["kind"] == 2, drift(d["hours"], d["strength"] / 24 * d["hours"] * level(acc))).otherwise(calm)

    def judged(sc: Column, acc: Column, d: Column) -> Column:
        room = n - d["hours"] - 1
        start = F.floor(d["place"] * room)
        clash = F.exists(accepted(acc), lambda e: (start < e["end"]) & (e["start"] < start + d["hours"]))
        # increments are computed only for draws that have a place
        add = F.when((room > 0) & ~clash, increments(sc, acc, d, start))
        reason = lambda a: F.when(room <= 0, NO_ROOM).when(clash, CLASH).when(F.coalesce(F.array_max(a) >= least, F.lit(False)), "").otherwise(WEAK)
        row = lambda a, why: F.struct(d["draw"].alias("draw"), d["kind"].alias("kind"), d["severity"].alias("severity"), start.alias("start"), (start + d["hours"]).alias("end"), why.alias("reason"), F.when(why == "", a).alias("add"))
        return let(add, lambda a: let(reason(a), lambda why: row(a, why)))

    def folded(sc: Column) -> Column:
        more = lambda acc, k: let(drawn(seed, k), lambda d: F.concat(acc, F.array(judged(sc, acc, d)).cast(_FOLDED)))
        step = lambda acc, k: F.when(F.size(accepted(acc)) >= n_events, acc).otherwise(more(acc, k))
        return F.aggregate(F.sequence(F.lit(0), F.lit(MOST_DRAWS - 1)), F.array().cast(_FOLDED), step)

    return one.select("entity", F.explode(let(scales, folded)).alias("d")).select("entity", "d.*")


def inject(panel: DataFrame, n_events: int = 6, seed: int = 123, span: str = "test", ref: str | None = "train", additive: bool = False, least_share: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, delta, draws) for the rows of ``span``; positions count from its first row. Events count in the order of acceptance;
    true_kwh is the sum of positive increments. All three are plans on ``sampled``."""
    drawn = sampled(panel, n_events, seed, span, ref, additive, least_share)
    kind = pick(list(KINDS), F.col("kind")).alias("type")
    # at most n_events rows an entity, so numbering them is cheap
    got = drawn.where("reason = ''").groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("draw", "kind", "severity", "start", "end", "add"))).alias("e"))
    got = got.select("entity", F.posexplode("e").alias("event_id", "e")).select("entity", "event_id", "e.*")
    total = F.aggregate("add", F.lit(0.0), lambda s, v: s + F.greatest(v, F.lit(0.0)))
    events = got.select("entity", "event_id", "start", "end", kind, "severity", pick(list(NAMES.values()), F.col("severity")).alias("severity_name"), total.alias("true_kwh")).select(*EVENTS)
    delta = got.select("entity", "start", F.posexplode("add").alias("k", "delta")).select("entity", (F.col("start") + F.col("k")).alias("idx"), "delta")
    return events, delta, drawn.select("entity", "draw", kind, "severity", (F.col("reason") == "").alias("accepted"), "reason").select(*DRAWS)
