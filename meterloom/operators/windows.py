"""Analytic windows over series, and the interval tables made from them.

All of these partition by entity and order by idx, so one exchange serves a chain of them. Rolling medians are
kept in an ordered window (see ``rolling``), whose cost a row hardly depends on the window's length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .intervals import rows_in
from .rolling import rolling_median_mad

#: The standard normal quantile at 0.99.
Z99 = 2.3263478740408408
MAD = 1.4826
TINY = 1e-9


def by_entity(*more: str) -> WindowSpec:
    return Window.partitionBy("entity", *more).orderBy("idx")


def _enough(v: Column, frame: WindowSpec, least: int, agg: Column) -> Column:
    return F.when(F.count(v).over(frame) >= least, agg.over(frame))


def _rolling_z(df: DataFrame, s: str, window: int, least: int, lag: int = 0, ahead: int = 0, fill: WindowSpec | None = None) -> DataFrame:
    """Adds med, mad and z of s: rolling median and MAD of s, ``lag`` rows late, each value of which is compared
    with the median at its own row."""
    p = rolling_median_mad(df, s, window, least, lag, ahead)
    med, mad = F.col("__med"), MAD * F.col("__mad")
    if fill is not None:
        later, back = fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, 0)
        med, mad = (F.coalesce(F.first(c, True).over(later), F.last(c, True).over(back)) for c in (med, mad))
    p = p.withColumns({"med": med, "mad": mad})
    return p.withColumn("z", (F.col(s) - F.col("med")) / (F.col("mad") + TINY)).drop("__med", "__mad")


def _flagged(df: DataFrame, level: float) -> DataFrame:
    return df.withColumn("flag", F.coalesce(F.col("z") > level, F.lit(False)))


def trailing_flags(df: DataFrame, s: str = "s", window: int = 336, least: int | None = None, level: float = Z99) -> DataFrame:
    """The strictly trailing flagger: a row is judged by the ``window`` rows before it, never by
    itself. Adds med, mad, z and flag; without enough history there is no flag."""
    return _flagged(_rolling_z(df, s, window, least or window // 4, lag=1), level)


def inclusive_flags(df: DataFrame, s: str = "s", window: int = 336, least: int | None = None, level: float = Z99) -> DataFrame:
    """The older trailing flagger, whose window ends with the row itself."""
    return _flagged(_rolling_z(df, s, window, least or window // 4), level)


def centered_flags(df: DataFrame, s: str = "s", window: int = 336, least: int | None = None, level: float = Z99) -> DataFrame:
    """The transductive flagger: a centred window; medians and MADs missing at the ends are filled
    from the nearest later, then earlier row."""
    return _flagged(_rolling_z(df, s, window, least or window // 4, ahead=(window - 1) // 2, fill=by_entity()), level)


def trailing_mean_squared(s: str = "s", window: int = 168, least: int = 24) -> Column:
    """The square of the trailing mean, the long scale of a residual."""
    frame = by_entity().rowsBetween(-(window - 1), 0)
    return F.pow(_enough(F.col(s), frame, least, F.avg(s)), F.lit(2.0))


def runs(df: DataFrame, flag: str = "flag", keys: tuple[str, ...] = ("entity",), gap: int = 0) -> DataFrame:
    """(keys, start, end): maximal runs of flagged rows as half-open intervals; runs whose flagged
    rows are at most ``gap`` apart are one (0 or 1: neighbours only)."""
    on = df.where(F.col(flag)).select(*keys, "idx")
    w = Window.partitionBy(*keys).orderBy("idx")
    new = F.coalesce(F.col("idx") - F.lag("idx").over(w) > max(gap, 1), F.lit(True)).cast("int")
    marked = on.withColumn("__new", new)
    marked = marked.withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy(*keys, "__run").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end")).drop("__run")


def bridged(gap: int = 6, flag: str = "flag") -> Column:
    """The flag, also set between flagged rows that are at most ``gap`` apart."""
    w = by_entity()
    at = F.when(F.col(flag), F.col("idx"))
    before = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.col(flag) | F.coalesce(after - before <= gap, F.lit(False))


def long_runs(r: DataFrame, least: int) -> DataFrame:
    return r.where(F.col("end") - F.col("start") >= least)


def merged_intervals(iv: DataFrame, gap: int = 6, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Unions of intervals that overlap or lie at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach + gap, F.lit(True)).cast("int")
    marked = iv.withColumn("__new", new)
    marked = marked.withColumn("__set", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__set").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__set")


def covered(iv: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(keys, idx), once each, of the rows that intervals cover."""
    return iv.where("end > start").select(*keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("idx")).distinct()


def smoothed3(x: str = "x") -> Column:
    """Centred three-point mean; two points at the ends."""
    return F.avg(x).over(by_entity().rowsBetween(-1, 1))


def sliding(df: DataFrame, x: str, length: int, stride: int) -> DataFrame:
    """(entity, start, values): windows of ``length`` rows, begun every ``stride`` rows."""
    w = by_entity().rowsBetween(0, length - 1)
    out = df.withColumn("values", F.collect_list(x).over(w))
    return out.where((F.col("idx") % stride == 0) & (F.size("values") == length)).select("entity", F.col("idx").alias("start"), "values")


def unslid(windows: DataFrame, values: str = "values", how: str = "avg") -> DataFrame:
    """(entity, idx, x): the mean (or maximum) over all windows that hold a row."""
    rows = windows.select("entity", "start", F.posexplode(values).alias("k", "v"))
    return rows.groupBy("entity", (F.col("start") + F.col("k")).alias("idx")).agg({"avg": F.avg, "max": F.max}[how]("v").alias("x"))


def windows_ahead(r: DataFrame, z: DataFrame, horizon: int) -> DataFrame:
    """(entity, start, idx, z) for the rows from each run's start on, ``horizon`` at most."""
    ahead = r.select("entity", "start", (F.col("start") + horizon).alias("end"))
    return rows_in(z.select("entity", "idx", "z"), ahead).select("entity", "start", "idx", "z")


def calm_ends(r: DataFrame, z: DataFrame, calm: int, level: float = 2.0, horizon: int = 336) -> DataFrame:
    """(entity, start, end): from each run's start until |z| stayed below ``level`` for ``calm`` rows
    (these included), or the horizon or the series ends."""
    w = Window.partitionBy("entity", "start").orderBy("idx")
    t = windows_ahead(r, z, horizon)
    loud = F.max(F.when(~F.coalesce(F.abs("z") < level, F.lit(False)), F.col("idx"))).over(w)
    t = t.withColumn("still", F.col("idx") - F.coalesce(loud, F.col("start") - 1))
    return t.groupBy("entity", "start").agg((F.coalesce(F.min(F.when(F.col("still") >= calm, F.col("idx"))), F.max("idx")) + 1).alias("end"))


def cusum_ends(r: DataFrame, z: DataFrame, slack: float = 1.0, least: int = 6, horizon: int = 336) -> DataFrame:
    """(entity, start, end): until the last peak of the one-sided CUSUM of z - slack, at least
    ``least`` rows. The CUSUM is the prefix sum minus its running minimum, so no fold is needed."""
    w = Window.partitionBy("entity", "start").orderBy("idx")
    t = windows_ahead(r, z, horizon).withColumn("p", F.sum(F.col("z") - slack).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.lit(0.0), F.min("p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("c", F.col("p") - low)
    top = t.groupBy("entity", "start").agg(F.max(F.struct("c", "idx")).alias("m"), F.max("idx").alias("last"))
    return top.select("entity", "start", F.least(F.greatest(F.col("m.idx") + 1, F.col("start") + least), F.col("last") + 1).alias("end"))
