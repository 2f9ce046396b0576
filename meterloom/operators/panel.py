"""Panels: dense series per entity. Columns: entity, idx (0-based position), ts, x, and what else is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import climate_proxy
from ..storage import stored


def resample(df: DataFrame, entity: str, ts: str, value: str, unit: str = "hour", how: str = "avg", digits: int | None = None) -> DataFrame:
    """(entity, ts, x): values aggregated by time unit."""
    x = {"avg": F.avg, "sum": F.sum}[how](value)
    x = F.round(x, digits) if digits is not None else x
    return df.groupBy(F.col(entity).alias("entity"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("ts")).agg(x.alias("x"))


def dense(panel: DataFrame, step: str = "1 hour", per_entity: bool = False) -> DataFrame:
    """Every entity at every step of the common time range (or its own); x is null where missing.
    Adds idx. The grid is made from one row per entity, so only the series themselves are shuffled."""
    if per_entity:
        span = panel.groupBy("entity").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    else:
        ends = panel.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
        span = panel.select("entity").distinct().select("entity", F.lit(ends["lo"]).cast("timestamp_ntz").alias("lo"), F.lit(ends["hi"]).cast("timestamp_ntz").alias("hi"))
    grid = span.select("entity", F.posexplode(F.expr(f"sequence(lo, hi, interval {step})")).alias("idx", "ts"))
    return grid.join(panel, ["entity", "ts"], "left").select("entity", F.col("idx").cast("long").alias("idx"), "ts", *[c for c in panel.columns if c not in ("entity", "ts")])


def positions(panel: DataFrame, span: bool = False) -> DataFrame:
    """Adds idx, the row's position in its entity (by ts); within each span if asked."""
    w = Window.partitionBy("entity", *(["span"] if span else [])).orderBy("ts")
    return panel.withColumn("span_idx" if span else "idx", (F.row_number().over(w) - 1).cast("long"))


def local_hours(panel: DataFrame, zone: str = "timezone") -> DataFrame:
    """UTC times (ts) become wall times of each row's zone; of two UTC hours that show the same
    wall time, the earlier stays."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.col(zone)).cast("timestamp_ntz")
    w = Window.partitionBy("entity", "local_ts").orderBy("ts")
    out = panel.withColumn("local_ts", local).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return out.drop("__n", "ts").withColumnRenamed("local_ts", "ts")


def interpolated(panel: DataFrame, x: str = "x", limit: int | None = 6, out: str = "x") -> DataFrame:
    """Linear interpolation between known values, for at most ``limit`` rows into a gap (the slope
    aims at the gap's far end); a gap's other rows keep the last value, leading ones take the first
    known. Null and NaN are missing."""
    by = Window.partitionBy("entity").orderBy("idx")
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    v = F.when(~F.isnan(x), F.col(x))
    known = F.when(v.isNotNull(), F.col("idx"))
    p = panel.withColumns({
        "__v0": F.last(v, True).over(back), "__i0": F.last(known, True).over(back),
        "__v1": F.first(v, True).over(ahead), "__i1": F.first(known, True).over(ahead),
    })
    into = F.col("idx") - F.col("__i0")
    step = (F.col("__v1") - F.col("__v0")) / (F.col("__i1") - F.col("__i0"))
    far = into if limit is None else F.least(into, F.lit(limit))
    value = F.when(into == 0, F.col("__v0")).when(F.col("__i1").isNull(), F.col("__v0")).when(F.col("__i0").isNull(), F.col("__v1")).otherwise(F.col("__v0") + step * far)
    return p.withColumn(out, value).drop("__v0", "__v1", "__i0", "__i1")


def fill_mask(panel: DataFrame, x: str = "x") -> DataFrame:
    """(entity, idx) of the rows whose value is missing and so will be invented."""
    return panel.where(F.col(x).isNull() | F.isnan(x)).select("entity", "idx")


def quality(panel: DataFrame, x: str = "x") -> DataFrame:
    """Per entity: n, completeness (share of rows with a value), mean, sd, top, and whether the
    series is degenerate (hardly varies, or is never positive)."""
    q = panel.groupBy("entity").agg(
        F.count("*").alias("n"), F.avg(F.col(x).isNotNull().cast("double")).alias("completeness"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.max(x).alias("top")
    )
    varies = (F.col("sd") > 0.05 * F.greatest(F.abs("mean"), F.lit(1e-9))) & (F.col("top") > 0)
    return q.withColumn("degenerate", ~F.coalesce(varies, F.lit(False)))


def select_top(q: DataFrame, group: str, n: int, least: float = 0.95) -> DataFrame:
    """The n most complete entities of each group among those complete enough and not degenerate;
    ties by name. Adds rank."""
    w = Window.partitionBy(group).orderBy(F.desc("completeness"), "entity")
    good = q.where((F.col("completeness") >= least) & ~F.col("degenerate"))
    return good.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def eligible(panel: DataFrame, x: str = "x", rows: int = 2000, share: float = 0.5) -> DataFrame:
    """Entities with enough rows, and values in enough of them."""
    return panel.groupBy("entity").agg(F.count("*").alias("n"), F.count(x).alias("n_known")).where((F.col("n") >= rows) & (F.col("n_known") >= share * F.col("n")))


def split(panel: DataFrame, train: float = 0.60, val: float = 0.15) -> DataFrame:
    """Adds span (train, val, test), by position, and span_idx, the position in it."""
    n = F.count("*").over(Window.partitionBy("entity"))
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))
    p = panel.withColumns({"__a": a, "__b": b})
    i = F.col("idx")
    return p.withColumns({
        "span": F.when(i < F.col("__a"), "train").when(i < F.col("__b"), "val").otherwise("test"),
        "span_idx": i - F.when(i < F.col("__a"), 0).when(i < F.col("__b"), F.col("__a")).otherwise(F.col("__b")),
    }).drop("__a", "__b")


def split_from_end(panel: DataFrame, val: float = 0.15, test: float = 0.25) -> DataFrame:
    """Adds span, with the sizes of test and validation rounded down and train the rest."""
    n = F.count("*").over(Window.partitionBy("entity"))
    b = n - F.floor(n * F.lit(test))
    a = b - F.floor(n * F.lit(val))
    return panel.withColumn("span", F.when(F.col("idx") < a, "train").when(F.col("idx") < b, "val").otherwise("test"))


def scale(panel: DataFrame, cols: list[str]) -> DataFrame:
    """Adds z_<col>: columns scaled by each entity's mean and sample deviation in the train span (a
    deviation of 0 counts as 1e-8)."""
    w = Window.partitionBy("entity")
    out = panel
    for c in cols:
        own = F.when(F.col("span") == "train", F.col(c))
        sd = F.stddev_samp(own).over(w)
        out = out.withColumn(f"z_{c}", (F.col(c) - F.avg(own).over(w)) / F.when(sd == 0, 1e-8).otherwise(sd))
    return out


def with_delta(panel: DataFrame, delta: DataFrame, scale_by: Column | None = None, x: str = "x", out: str = "x") -> DataFrame:
    """x plus the increments (entity, idx, delta) that fall on a row, over ``scale_by`` if given."""
    d = F.coalesce("delta", F.lit(0.0))
    d = d / scale_by if scale_by is not None else d
    return panel.join(delta, ["entity", "idx"], "left").withColumn(out, F.col(x) + d).drop("delta")


def site_hours(sites: DataFrame, weather: DataFrame, limit: int | None = 6) -> DataFrame:
    """(site_id, ts, temp): each site's readings by its own wall time, gaps filled, once a site however many entities it has.

    Null readings are none. Of a site's readings of one local time (those of a repeated UTC time, and both hours that the end of
    summer time shows twice) the one of the earliest UTC time stays, at the same UTC time the lowest. The grid runs over all readings' hours."""
    zones = sites.where("site_id is not null").groupBy("site_id").agg(F.min("timezone").alias("timezone"))
    local = F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), F.col("timezone")).cast("timestamp_ntz")
    known = weather.where(F.col("airTemperature").isNotNull() & ~F.isnan("airTemperature")).join(zones, "site_id").withColumn("ts", local).where("ts is not null")
    first = Window.partitionBy("site_id", "ts").orderBy("timestamp", "airTemperature")
    known = known.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(F.col("site_id").alias("entity"), "ts", F.col("airTemperature").alias("x"))
    return interpolated(dense(known, per_entity=True), limit=limit).select(F.col("entity").alias("site_id"), "ts", F.col("x").alias("temp"))


def with_weather(panel: DataFrame, sites: DataFrame, weather: DataFrame, limit: int = 6, out: str = "temp") -> DataFrame:
    """``panel`` (entity, idx, ts, ...; wall times) with its site's temperature in ``out``, and ``measured``: whether the site
    has any. sites: (entity, site_id, lat, timezone), a row an entity; weather: (site_id, timestamp, airTemperature) in UTC. Gaps between
    readings are interpolated for up to ``limit`` hours, then the last reading holds, as it does after the last one; before the first,
    the first counts. A site without readings gets the climatological proxy of its latitude."""
    hours = stored(site_hours(sites, weather, limit), "site-hours")
    ends = hours.groupBy("site_id").agg(F.min(F.struct("ts", "temp")).alias("__lo"), F.max(F.struct("ts", "temp")).alias("__hi"))
    rows = panel.join(sites.select("entity", "site_id", "lat"), "entity", "left")
    rows = rows.join(hours.select("site_id", "ts", F.col("temp").alias("__t")), ["site_id", "ts"], "left").join(ends, "site_id", "left")
    outside = F.when(F.col("ts") < F.col("__lo.ts"), F.col("__lo.temp")).when(F.col("ts") > F.col("__hi.ts"), F.col("__hi.temp"))
    rows = rows.withColumn("__t", F.coalesce("__t", outside))
    return rows.withColumns({"measured": F.col("__t").isNotNull(), out: F.coalesce("__t", climate_proxy(F.col("ts"), F.col("lat")))}).drop("__t", "__lo", "__hi")
