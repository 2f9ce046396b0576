"""Detection measures. Flags: (entity, idx, flag). Events: (entity, event_id, start, end, type,
severity, true_kwh), half-open intervals of idx.

Rows meet intervals, and intervals each other, by time bins (see ``intervals``), however long the intervals are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import rows_in, shared_rows
from .windows import merged_intervals, runs


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def event_detail(flags: DataFrame, events: DataFrame) -> DataFrame:
    """Per event: duration, detected, delay to the first flag (null if none), share of rows flagged."""
    hits = rows_in(flags.where("flag").select("entity", "idx"), events).select(*events.columns, F.col("idx").alias("__hit"))
    every = events.where("end > start").withColumn("__hit", F.lit(None).cast("long"))
    length = F.col("end") - F.col("start")
    out = hits.unionByName(every).groupBy(*events.columns).agg(F.min("__hit").alias("__first"), (F.count("__hit") / F.first(length)).alias("range_cov"))
    return out.withColumns({"duration": length, "detected": F.col("__first").isNotNull(), "delay": F.col("__first") - F.col("start")}).drop("__first")


def run_detail(flags: DataFrame, events: DataFrame) -> DataFrame:
    """Per run: whether it meets an event, and the share of its rows that do."""
    r = shared_rows(runs(flags), events).withColumn("overlap", F.col("shared") / (F.col("end") - F.col("start")))
    return r.drop("shared").withColumn("matched", F.col("overlap") > 0)


def alarm_rate(flags: DataFrame, events: DataFrame) -> DataFrame:
    """(entity, false_alarm_rate): the share of rows outside events that are flagged."""
    rest = rows_in(flags, events, "left_anti")
    return rest.groupBy("entity").agg(F.avg(F.col("flag").cast("double")).alias("false_alarm_rate"))


def detection(flags: DataFrame, events: DataFrame) -> DataFrame:
    """Per entity with events: event recall, run precision (0 without runs), F1, mean delay, alarm
    rate outside events, and the range-based precision, recall and F1 (mean overlap shares)."""
    ev = event_detail(flags, events).groupBy("entity").agg(
        F.count("*").alias("n_events"), F.count(F.when(F.col("detected"), 1)).alias("tp_events"), F.avg("delay").alias("detection_delay"), F.avg("range_cov").alias("range_recall")
    )
    rn = run_detail(flags, events).groupBy("entity").agg(
        F.count("*").alias("n_runs"), F.count(F.when(F.col("matched"), 1)).alias("tp_runs"), F.avg("overlap").alias("range_precision")
    )
    out = ev.join(rn, "entity", "left").join(alarm_rate(flags, events), "entity", "left").na.fill(0, ["n_runs", "tp_runs"]).na.fill(0.0, ["range_precision", "false_alarm_rate"])
    out = out.withColumns({
        "recall": F.col("tp_events") / F.col("n_events"),
        "precision": F.when(F.col("n_runs") > 0, F.col("tp_runs") / F.col("n_runs")).otherwise(0.0),
    })
    return out.withColumns({"f1": f1(F.col("precision"), F.col("recall")), "range_f1": f1(F.col("range_precision"), F.col("range_recall"))})


def micro_f1(flags: DataFrame, events: DataFrame, keys: list[str | Column] | None = None) -> DataFrame:
    """F1 of events and runs pooled over entities (one row, or one for each of ``keys``)."""
    d = detection(flags, events)
    g = d.groupBy(*keys) if keys else d.groupBy()
    s = g.agg(*[F.sum(c).alias(c) for c in ("tp_events", "n_events", "tp_runs", "n_runs")])
    p, r = F.col("tp_runs") / F.greatest("n_runs", F.lit(1)), F.col("tp_events") / F.greatest("n_events", F.lit(1))
    return s.withColumn("micro_f1", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))


def recall_by(detail: DataFrame, *keys: str, total: bool = False) -> DataFrame:
    """Recall, number and mean delay of events by type, severity or both; with ``total`` also over
    all of each (a rollup; null keys)."""
    g = detail.rollup(*keys) if total else detail.groupBy(*keys)
    return g.agg(F.count("*").alias("n"), F.avg(F.col("detected").cast("double")).alias("recall"), F.avg("delay").alias("delay"))


def mean_of_groups(detail: DataFrame, inner: list[str], outer: list[str], x: str) -> DataFrame:
    """The mean over inner groups of their means (not the pooled mean)."""
    d = detail.groupBy(*dict.fromkeys([*inner, *outer])).agg(F.avg(x).alias("__m"))
    return d.groupBy(*outer).agg(F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("sd"), F.count("*").alias("n"))


def label_overlap(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Per entity, for labelled rows (entity, idx, anomaly): label and alarm rates, share of alarms that
    are labelled, share of labels found, and share of runs that meet a label."""
    both = flags.select("entity", "idx", "flag").join(labels.select("entity", "idx", (F.col("anomaly") == 1).alias("lab")), ["entity", "idx"], "left").na.fill(False, ["lab"])
    n = lambda c: F.count(F.when(c, 1))
    rate = both.groupBy("entity").agg(
        F.avg(F.col("lab").cast("double")).alias("label_rate"),
        F.avg(F.col("flag").cast("double")).alias("alarm_rate"),
        F.try_divide(n(F.col("flag") & F.col("lab")), n(F.col("flag"))).alias("alarm_precision"),
        F.try_divide(n(F.col("flag") & F.col("lab")), n(F.col("lab"))).alias("label_recall"),
    )
    lab = runs(both, "lab").select("entity", "start", "end")
    run_p = run_detail(flags, lab).groupBy("entity").agg(F.avg(F.col("matched").cast("double")).alias("run_precision"))
    return rate.join(run_p, "entity", "left")


def duration_bins(iv: DataFrame, edges: tuple[int, ...] = (0, 2, 6, 24, 1_000_000)) -> Column:
    """The right-closed bin of an interval's length, from 0."""
    d = F.col("end") - F.col("start")
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out = F.when((d > a) & (d <= b), i).otherwise(out)
    return out


def alarm_attribution(flags: DataFrame, events: DataFrame, panel: DataFrame, edge: int = 24) -> DataFrame:
    """False alarm rows by hour band, weekend, closeness to an event and length of their run."""
    near = events.select("entity", (F.col("start") - edge).alias("start"), (F.col("end") + edge).alias("end"))
    false = rows_in(covered_runs(flags), events, "left_anti")
    close = rows_in(false.select("entity", "idx"), merged_intervals(near, 0)).select("entity", "idx", F.lit(True).alias("__near"))
    at = false.join(panel.select("entity", "idx", "ts"), ["entity", "idx"]).join(close, ["entity", "idx"], "left")
    h = F.hour("ts")
    return at.groupBy(
        F.when(h < 6, "night").when(h < 9, "morning").when(h < 18, "day").otherwise("evening").alias("band"),
        (F.weekday("ts") >= 5).alias("weekend"),
        F.coalesce("__near", F.lit(False)).alias("edge"),
        F.when(F.col("length") <= 1, "1").when(F.col("length") <= 6, "2-6").otherwise("7+").alias("run_length"),
    ).agg(F.count("*").alias("n"))


def covered_runs(flags: DataFrame) -> DataFrame:
    """(entity, idx, length): flagged rows with the length of their run."""
    return rows_in(flags.where("flag").select("entity", "idx"), runs(flags)).select("entity", "idx", (F.col("end") - F.col("start")).alias("length"))


def alarm_scales(scored: DataFrame, events: DataFrame, short: str = "s", long: str = "long") -> DataFrame:
    """(entity, n, short_driven): false alarm runs, and how many of them have a mean short score that is at
    least their mean long score (a missing mean drives nothing)."""
    false = run_detail(scored, events).where(~F.col("matched")).select("entity", "start", "end")
    rows = rows_in(scored.select("entity", "idx", F.col(short).alias("__s"), F.col(long).alias("__l")), false)
    per = rows.groupBy("entity", "start").agg((F.avg("__s") >= F.avg("__l")).alias("short"))
    return per.groupBy("entity").agg(F.count("*").alias("n"), F.count(F.when(F.col("short"), 1)).alias("short_driven"))
