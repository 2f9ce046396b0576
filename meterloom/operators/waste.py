"""Excess quantities. Residuals: (entity, idx, resid) in the load's unit, missing counts as 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import event_detail
from .intervals import rows_in
from .scoring import median_mad
from .windows import calm_ends, covered, cusum_ends, merged_intervals, runs

#: Extension rules, in order of preference.
MODES = ("none", "z6", "z12", "cusum")


def clipped(resid: str = "resid") -> Column:
    r = F.col(resid)
    return F.when(r.isNull() | F.isnan(r), 0.0).otherwise(F.greatest(r, F.lit(0.0)))


def extended(flags: DataFrame, z: DataFrame, mode: str, horizon: int = 336) -> DataFrame:
    """(entity, idx): the rows over which a rule adds up residuals: flagged rows, or those of windows
    that begin with a run and last until z calms down (6 or 12 rows) or its CUSUM peaks."""
    if mode == "none":
        return flags.where("flag").select("entity", "idx")
    r = runs(flags)
    ends = cusum_ends(r, z, horizon=horizon) if mode == "cusum" else calm_ends(r, z, int(mode[1:]), horizon=horizon)
    return covered(merged_intervals(ends))


def decomposition(resid: DataFrame, flags: DataFrame, events: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Per entity with events: estimate, truth and the exact split of their difference,
    est - true = matched_err + false_add + unmatched_ev_flagged - missed. ``rows``: where residuals are
    added up (default: flagged rows). An event is matched if it has a flagged row."""
    rows = flags.where("flag").select("entity", "idx") if rows is None else rows
    detail = event_detail(flags, events).select("entity", "event_id", "start", "end", "true_kwh", "detected")
    hours = rows_in(resid.select("entity", "idx"), detail).groupBy("entity", "idx").agg(F.max("detected").alias("hit"))
    at = resid.select("entity", "idx", clipped().alias("rc")).join(rows.withColumn("__in", F.lit(True)), ["entity", "idx"], "left").join(hours, ["entity", "idx"], "left")
    use, ev = F.coalesce("__in", F.lit(False)), F.col("hit").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("rc"))), F.lit(0.0))
    est = at.groupBy("entity").agg(
        total(use).alias("est_kwh"), total(use & ev & F.col("hit")).alias("__m"), total(use & ev & ~F.col("hit")).alias("unmatched_ev_flagged_kwh"), total(use & ~ev).alias("false_add_kwh"),
        F.avg(F.when(ev, use.cast("double"))).alias("window_cov"),
    )
    tr = detail.groupBy("entity").agg(
        F.sum("true_kwh").alias("true_kwh"), F.sum(F.when(F.col("detected"), F.col("true_kwh")).otherwise(0.0)).alias("__t"), F.avg(F.col("detected").cast("double")).alias("frac_events_matched")
    )
    out = tr.join(est, "entity")
    out = out.withColumns({
        "delta_kwh": F.col("est_kwh") - F.col("true_kwh"),
        "bias": F.when(F.col("true_kwh") != 0, (F.col("est_kwh") - F.col("true_kwh")) / F.col("true_kwh")),
        "matched_err_kwh": F.col("__m") - F.col("__t"),
        "missed_kwh": F.col("true_kwh") - F.col("__t"),
    })
    return out.drop("__m", "__t")


def noise(resid: DataFrame, events: DataFrame) -> DataFrame:
    """(entity, sigma): 1.4826 MAD of residuals outside events."""
    rest = rows_in(resid, events, "left_anti")
    return median_mad(rest, ["entity"], "resid").select("entity", F.col("mad").alias("sigma"))


def oracle(resid: DataFrame, events: DataFrame) -> DataFrame:
    """Per entity, over true event windows: truth, and the sums of clipped residuals, of signed ones,
    and of clipped ones less what noise alone adds (per event at least 0)."""
    rows = rows_in(resid.where(F.col("resid").isNotNull() & ~F.isnan("resid")), events).join(noise(resid, events), "entity")
    ev = rows.groupBy("entity", "event_id", "true_kwh").agg(F.sum(F.greatest("resid", F.lit(0.0))).alias("clip"), F.sum("resid").alias("signed"), F.count("*").alias("n"), F.first("sigma").alias("sigma"))
    floor = F.greatest(F.col("clip") - F.col("n") * F.col("sigma") / math.sqrt(2 * math.pi), F.lit(0.0))
    return ev.groupBy("entity").agg(F.sum("true_kwh").alias("true_kwh"), F.sum("clip").alias("clip_kwh"), F.sum("signed").alias("signed_kwh"), F.sum(floor).alias("floor_kwh"))


def extensions(resid: DataFrame, z: DataFrame, flags: DataFrame, events: DataFrame, modes: tuple[str, ...] = MODES, horizon: int = 336) -> DataFrame:
    """The decomposition under each rule, with column mode."""
    out = None
    for m in modes:
        d = decomposition(resid, flags, events, extended(flags, z, m, horizon)).withColumn("mode", F.lit(m))
        out = d if out is None else out.unionByName(d)
    return out


def chosen_mode(ext: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """(mode, obj), one row: the rule with the least median over entities of |bias|; ties (to nine places, as sums
    come in any order): the earlier."""
    obj = ext.groupBy("mode").agg(F.percentile(F.abs("bias"), F.lit(0.5)).alias("obj"))
    order = F.array_position(F.array(*map(F.lit, modes)), F.col("mode"))
    return obj.orderBy(F.round("obj", 9), order).limit(1)


def level_bias(resid: DataFrame, events: DataFrame, sd: DataFrame) -> DataFrame:
    """Per event: the mean of (residual - true increment per row) in units of the entity's sd."""
    rows = rows_in(resid, events).groupBy("entity", "event_id", "true_kwh").agg(F.avg("resid").alias("m"), F.count("*").alias("n"))
    return rows.join(sd, "entity").select("entity", "event_id", ((F.col("m") - F.col("true_kwh") / F.col("n")) / F.col("sd")).alias("level_bias"))


def relative_errors(ev: DataFrame, est: str = "est", true: str = "true_kwh") -> DataFrame:
    """The older summary over events: totals, mean relative error, relative error of the total."""
    e, t = F.col(est), F.col(true)
    out = ev.groupBy("entity").agg(F.sum(e).alias("waste_est_kwh"), F.sum(t).alias("waste_true_kwh"), F.avg(F.abs(e - t) / F.greatest(t, F.lit(1e-6))).alias("waste_error_mean"))
    return out.withColumn("waste_error_total", F.abs(F.col("waste_est_kwh") - F.col("waste_true_kwh")) / F.greatest("waste_true_kwh", F.lit(1e-6)))


def gross_error(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Errors over entities without cancelling: the parts' absolute values are summed per entity."""
    parts = F.abs("matched_err_kwh") + F.abs("false_add_kwh") + F.abs("missed_kwh")
    return ops.groupBy(*keys).agg((F.sum(parts) / F.sum("true_kwh")).alias("gross_rel"), ((F.sum("est_kwh") - F.sum("true_kwh")) / F.sum("true_kwh")).alias("bias"))
