"""Summaries of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scoring import median_mad


def weighted_mean(x: str, w: str) -> Column:
    """Mean of x with weights w; rows without x don't count."""
    return F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(F.when(F.col(x).isNotNull(), F.col(w))))


def means(df: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of every numeric column, nulls and NaN left out."""
    kinds = (T.NumericType, T.BooleanType)
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in keys]
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.groupBy(*keys).agg(*[F.avg(real(c)).alias(c) for c in cols])


def spread(df: DataFrame, keys: list[str], x: str, below: tuple[float, ...] = ()) -> DataFrame:
    """Quartiles and the 0.9 quantile of x, and the shares of rows with x at most each of ``below``."""
    q = F.percentile(x, F.array(*[F.lit(v) for v in (0.25, 0.5, 0.75, 0.9)]))
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), q.alias("__q"), *[F.avg((F.col(x) <= b).cast("double")).alias(f"share_{b:g}") for b in below])
    return out.select("*", *[F.col("__q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75", "q90"))]).drop("__q")


def draw_counts(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Fault draws: all, accepted, and rejected by reason."""
    n = lambda c: F.count_if(c)
    return draws.groupBy(*keys).agg(
        F.count("*").alias("draws"), n(F.col("accepted")).alias("accepted"), n(F.col("reason") == "overlap").alias("overlap"), n(F.col("reason").startswith("peak")).alias("weak")
    )


def seen_unseen(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Means of x for seen and unseen entities side by side, and their difference."""
    p = df.groupBy(*keys).pivot("seen", [True, False]).agg(F.avg(x)).withColumnsRenamed({"true": "on_seen", "false": "on_unseen"})
    return p.withColumn("gap", F.col("on_seen") - F.col("on_unseen"))


def realism(delta: DataFrame, events: DataFrame, resid: DataFrame, load: DataFrame, filled: DataFrame | None = None) -> DataFrame:
    """Per event: its mean and peak increment in robust deviations of the clean residual, its share of the
    energy used meanwhile, and how many of its rows were filled in.

    delta: (entity, idx, delta); resid: (entity, idx, resid) without faults; load: (entity, idx, x);
    filled: (entity, idx)."""
    noise = median_mad(resid, ["entity"], "resid").select("entity", F.col("mad").alias("sigma"))
    rows = events.select("entity", "event_id", "type", "severity", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("idx"))
    rows = rows.join(delta, ["entity", "idx"], "left").join(load.select("entity", "idx", "x"), ["entity", "idx"], "left").join(noise, "entity", "left")
    mark = F.lit(0)
    if filled is not None:
        rows, mark = rows.join(filled.select("entity", "idx").withColumn("__f", F.lit(1)), ["entity", "idx"], "left"), F.coalesce("__f", F.lit(0))
    d = F.coalesce("delta", F.lit(0.0))
    return rows.groupBy("entity", "event_id", "type", "severity").agg(
        F.avg(d / F.nullif("sigma", F.lit(0.0))).alias("mean_sigma"), F.max(d / F.nullif("sigma", F.lit(0.0))).alias("peak_sigma"), F.max(d).alias("peak"),
        F.try_divide(F.sum(d), F.sum("x")).alias("energy_share"), F.sum(mark).cast("long").alias("filled"),
    )
