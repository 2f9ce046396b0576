"""Joins of rows and half-open intervals of idx, by time bins.

A row belongs to one bin of ``width`` neighbouring positions, an interval to each bin that it reaches: an interval of a
year of hours is some dozens of rows, not one for each hour. Rows and intervals meet by equality of entity and bin,
and an exact comparison decides. Intervals without rows (end <= start) hold nothing; a null entity is in none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a bin.
WIDTH = 256


def _binned(intervals: DataFrame, width: int) -> DataFrame:
    """Each interval in each of its bins."""
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    return intervals.where("end > start").withColumn("__bin", F.explode(bins))


def rows_in(rows: DataFrame, intervals: DataFrame, how: str = "inner", width: int = WIDTH) -> DataFrame:
    """``rows`` (entity, idx, ...) with the columns of each interval (entity, start, end, ...) that holds them; or, with
    left_semi and left_anti, the rows that some interval holds, or none. Overlapping intervals are merged for these."""
    if how != "inner":
        from .windows import merged_intervals

        intervals = merged_intervals(intervals.where("end > start").select("entity", "start", "end"), 0)
    right = _binned(intervals, width).withColumnsRenamed({"entity": "__entity", "__bin": "__right"})
    left = rows.withColumn("__bin", F.floor(F.col("idx") / width))
    holds = (left["entity"] == right["__entity"]) & (left["__bin"] == right["__right"]) & (left["idx"] >= right["start"]) & (left["idx"] < right["end"])
    return left.join(right, holds, how).drop("__bin", "__right", "__entity")


def shared_rows(intervals: DataFrame, others: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct ``intervals`` (entity, start, end) with ``shared``: how many of their positions some of ``others`` hold."""
    from .windows import merged_intervals

    keys = ["entity", "start", "end"]
    intervals = intervals.select(*keys).distinct()
    left = _binned(intervals, width)
    right = _binned(merged_intervals(others.select(*keys), 0), width).withColumnsRenamed({"entity": "__entity", "start": "__start", "end": "__end", "__bin": "__right"})
    both = left.join(right, (left["entity"] == right["__entity"]) & (left["__bin"] == right["__right"]))
    # what a pair shares in each bin adds up, so pairs that meet in several bins are not counted twice
    low = F.greatest("start", "__start", F.col("__bin") * width)
    high = F.least("end", "__end", (F.col("__bin") + 1) * width)
    part = both.select(*keys, F.greatest(high - low, F.lit(0)).alias("shared"))
    return part.unionByName(intervals.withColumn("shared", F.lit(0).cast("long"))).groupBy(*keys).agg(F.sum("shared").alias("shared"))
