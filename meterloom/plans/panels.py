"""The panels that the registered queries run on: hourly sums of events by type, and daily order values
by priority, split by time, with planted events whose increments are known."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as P
from ..storage import released, shared_dir, stored

#: Planted events: how many, where the first begins in the test span, their spacing and lengths.
N_EVENTS, FIRST, SPACING, SHORTEST, LONGER = 6, 180, 60, 4, 6
KINDS = ("spike", "drift", "schedule")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, idx, ts, x): hourly value sums by event type on a dense grid; null where nothing came."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    return P.dense(P.resample(e, "event_type", "ts", "value", "hour", "sum", 4))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, idx, ts, x, slot, span, span_idx): daily order value (thousands) by priority, 0 on days
    without orders."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    d = P.dense(P.resample(o, "o_orderpriority", "o_orderdate", "o_totalprice", "day", "sum", 2), "1 day")
    d = d.withColumns({"x": F.coalesce(F.col("x") / 1000, F.lit(0.0)), "slot": F.weekday("ts")})
    return P.split(d)


def scales(d: DataFrame) -> DataFrame:
    """(entity, sd): the population deviation of the train span, to 3 places."""
    return d.where("span = 'train'").groupBy("entity").agg(F.round(F.stddev_pop("x"), 3).alias("sd"))


def planted(d: DataFrame) -> DataFrame:
    """Events in the test span, in its positions: each adds its severity times the train deviation to
    every row."""
    k = F.explode(F.sequence(F.lit(0), F.lit(N_EVENTS - 1))).alias("k")
    e = scales(d).select("entity", "sd", k)
    start, n = (F.lit(FIRST) + SPACING * F.col("k")).cast("long"), SHORTEST + LONGER * F.col("k")
    e = e.select(
        "entity", F.col("k").alias("event_id"), start.alias("start"), (start + n).alias("end"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % 3 + 1).cast("int")).alias("type"), (F.floor(F.col("k") / 2) + 1).cast("int").alias("severity"), "sd",
    )
    return e.withColumn("true_kwh", F.round((F.col("end") - F.col("start")) * F.col("severity") * F.col("sd"), 6)).withColumn("add", F.col("severity") * F.col("sd")).drop("sd")


def injected(d: DataFrame, ev: DataFrame) -> DataFrame:
    """The panel with the planted increments in its test span."""
    rows = ev.select("entity", "add", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("span_idx"), F.lit("test").alias("span"))
    return d.join(rows, ["entity", "span", "span_idx"], "left").withColumn("x", F.col("x") + F.coalesce("add", F.lit(0.0))).drop("add")


def test_span(d: DataFrame) -> DataFrame:
    """The test rows, with idx counted from the span's start."""
    return d.where("span = 'test'").drop("idx").withColumnRenamed("span_idx", "idx")


def drained(spark: SparkSession, sf_dir: str, plan, mode: str, source: DataFrame | None = None, files: int = 6, late: int = 40) -> DataFrame:
    """What a streaming plan gives once it has read all of the events (or of ``source``), ordered by ts but for
    up to ``late`` minutes, in ``files`` files, one a micro-batch. After half of them the query ends; it is started again from its
    checkpoint once the others have come. All is in the folder that driver and executors share."""
    from ..streaming.online import PROVIDER

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events") if source is None else source
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    come = seconds + F.pmod(F.xxhash64(*[F.col(c) for c in source.columns]), F.lit(60 * late))
    source = stored(source.withColumn("__come", come), "stream-source")
    lo, hi = source.agg(F.min("__come"), F.max("__come")).first()
    lo, hi = lo or 0, hi or 0
    cuts = [lo + (hi + 1 - lo) * k // files for k in range(files + 1)]
    schema = source.drop("__come").schema
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        for part in (range(files // 2), range(files // 2, files)):
            for k in part:  # files are read in the order of their times
                source.where((F.col("__come") >= cuts[k]) & (F.col("__come") < cuts[k + 1])).drop("__come").coalesce(1).write.mode("append").parquet(f"{base}/in")
            out = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
            q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").format("parquet").trigger(availableNow=True).start(f"{base}/out")
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    released(source)
    got = spark.read.schema(out.schema).parquet(f"{base}/out")
    got._batches = q.lastProgress["batchId"] + 1 if q.lastProgress else 0
    return got
