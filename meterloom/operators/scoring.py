"""Robust scores: medians and MADs of a frozen reference, by calendar slot, and the scores made with them.

Profiles are small tables keyed by entity (and slot) that are joined back; where the reference is
the entity's own earlier rows, one shuffle by entity serves the aggregate and the join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import MAD, TINY, trailing_mean_squared


def median_mad(ref: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """(keys, med, mad, n): median, 1.4826 times the median distance from it, and number of values."""
    w = Window.partitionBy(*keys)
    known = ref.where(F.col(x).isNotNull() & ~F.isnan(x)).select(*keys, F.col(x).alias("__x"))
    near = known.withColumn("__med", F.percentile("__x", F.lit(0.5)).over(w))
    return near.groupBy(*keys).agg(F.first("__med").alias("med"), (MAD * F.percentile(F.abs(F.col("__x") - F.col("__med")), F.lit(0.5))).alias("mad"), F.count("*").alias("n"))


def slot_profile(ref: DataFrame, slot: str = "slot", x: str = "x") -> DataFrame:
    """(entity, slot, med): the median of each calendar slot."""
    return ref.groupBy("entity", slot).agg(F.percentile(x, F.lit(0.5)).alias("med"))


def profile_residual(df: DataFrame, profile: DataFrame, scale_by: DataFrame | None = None, slot: str = "slot", x: str = "x", out: str = "r") -> DataFrame:
    """x minus its slot's median (null for slots without one), over sd if ``scale_by`` (entity, sd) is given."""
    p = df.join(profile, ["entity", slot], "left")
    r = F.col(x) - F.col("med")
    if scale_by is not None:
        p, r = p.join(scale_by, "entity", "left"), r / F.col("sd")
    return p.withColumn(out, r).drop("med", *(["sd"] if scale_by is not None else []))


def slot_z(df: DataFrame, ref: DataFrame, slot: str | None = "slot", x: str = "x", least: int = 20, out: str = "s") -> DataFrame:
    """The robust z of x by its slot's statistics in ``ref``; slots with fewer than ``least`` values
    use the entity's pooled statistics, and with ``slot`` None all do."""
    pooled = median_mad(ref, ["entity"], x).select("entity", F.col("med").alias("__pm"), F.col("mad").alias("__ps"))
    p = df.join(pooled, "entity", "left")
    med, mad = F.col("__pm"), F.col("__ps")
    if slot is not None:
        p = p.join(median_mad(ref, ["entity", slot], x), ["entity", slot], "left")
        own = F.coalesce(F.col("n") >= least, F.lit(False))
        med, mad = F.when(own, F.col("med")).otherwise(med), F.when(own, F.col("mad")).otherwise(mad)
    p = p.withColumn(out, (F.col(x) - med) / (mad + TINY))
    return p.drop("__pm", "__ps", "med", "mad", "n")


def long_z(df: DataFrame, ref: DataFrame, x: str = "x", window: int = 168, least: int = 24, out: str = "long") -> DataFrame:
    """The robust z of the squared trailing mean, by its statistics in ``ref``."""
    stats = median_mad(ref.withColumn("__q", trailing_mean_squared(x, window, least)), ["entity"], "__q")
    p = df.withColumn("__q", trailing_mean_squared(x, window, least)).join(stats, "entity", "left")
    return p.withColumn(out, (F.col("__q") - F.col("med")) / (F.col("mad") + TINY)).drop("__q", "med", "mad", "n")


def fused(w: float, short: str = "s", long: str = "long") -> Column:
    """w times the short score plus 1 - w times the long one; a weight of 0 leaves its score out, also
    where that is missing."""
    if w == 1:
        return F.col(short)
    return F.col(long) if w == 0 else w * F.col(short) + (1 - w) * F.col(long)


def fused_max(short: str = "s", long: str = "long") -> Column:
    """The larger of two scores; missing if either is."""
    return F.when(F.col(short).isNotNull() & F.col(long).isNotNull(), F.greatest(short, long))


def quantile_threshold(val: DataFrame, x: str = "s", rate: float = 0.01) -> DataFrame:
    """(entity, level): the score that a share ``rate`` of the validation rows exceeds."""
    return val.groupBy("entity").agg(F.percentile(x, F.lit(1 - rate)).alias("level"))


def adapted_threshold(val: DataFrame, test: DataFrame, x: str = "s", rate: float = 0.01) -> DataFrame:
    """(entity, level): the validation level times the ratio of the test's MAD to the validation's."""
    a = median_mad(val, ["entity"], x).select("entity", F.col("mad").alias("v"))
    b = median_mad(test, ["entity"], x).select("entity", F.col("mad").alias("t"))
    out = quantile_threshold(val, x, rate).join(a, "entity").join(b, "entity")
    return out.select("entity", (F.col("level") * F.col("t") / (F.col("v") + TINY)).alias("level"))


def towt_residual(df: DataFrame, train: Column, slot: str = "slot", x: str = "x", temp: str = "temp", out: str = "r") -> DataFrame:
    """The residual of a regression of x on slot dummies, temp and its square, fitted on the rows where
    ``train`` holds. Within slots all is centred (Frisch-Waugh), which leaves two normal equations per
    entity, solved by aggregates. A slot without training rows has no level and gives null."""
    w = Window.partitionBy("entity", slot)
    own = lambda c: F.when(train, c)
    t1, t2, y = F.col(temp), F.pow(F.col(temp), F.lit(2.0)), F.col(x)
    p = df.withColumns({"__a": F.avg(own(t1)).over(w), "__b": F.avg(own(t2)).over(w), "__y": F.avg(own(y)).over(w)})
    e = Window.partitionBy("entity")
    a, b, v = t1 - F.col("__a"), t2 - F.col("__b"), y - F.col("__y")
    sums = {"__aa": a * a, "__ab": a * b, "__bb": b * b, "__av": a * v, "__bv": b * v}
    p = p.withColumns({k: F.sum(own(c)).over(e) for k, c in sums.items()})
    det = F.col("__aa") * F.col("__bb") - F.col("__ab") * F.col("__ab")
    # collinear temperatures: only the first counts
    full = det > 1e-12 * F.col("__aa") * F.col("__bb")
    k1 = F.when(full, (F.col("__av") * F.col("__bb") - F.col("__bv") * F.col("__ab")) / det).when(F.col("__aa") > 0, F.col("__av") / F.col("__aa")).otherwise(0.0)
    k2 = F.when(full, (F.col("__bv") * F.col("__aa") - F.col("__av") * F.col("__ab")) / det).otherwise(0.0)
    return p.withColumn(out, v - k1 * a - k2 * b).drop("__a", "__b", "__y", *sums)


def excursions(df: DataFrame, ref: DataFrame, x: str = "r") -> DataFrame:
    """Per entity: shares of rows with |z| over 3 and 5 and the longest stretch over 3, z by the
    reference's median and MAD (no epsilon; a MAD of 0 gives no excursions)."""
    from .windows import runs

    st = median_mad(ref, ["entity"], x)
    z = df.join(st, "entity").withColumn("__z", F.abs(F.try_divide(F.col(x) - F.col("med"), F.col("mad")))).withColumn("flag", F.coalesce(F.col("__z") > 3, F.lit(False)))
    longest = runs(z).groupBy("entity").agg(F.max(F.col("end") - F.col("start")).alias("longest"))
    share = z.groupBy("entity").agg(*[F.avg(F.coalesce(F.col("__z") > k, F.lit(False)).cast("double")).alias(f"over{k}") for k in (3, 5)])
    return share.join(longest, "entity", "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def outside_range(df: DataFrame, ref: DataFrame, x: str = "temp") -> DataFrame:
    """(entity, share): rows whose x lies outside the range that the reference has."""
    r = ref.groupBy("entity").agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    return df.join(r, "entity").groupBy("entity").agg(F.avg((~F.col(x).between(F.col("lo"), F.col("hi"))).cast("double")).alias("share"))
