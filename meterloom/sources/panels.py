"""Reading and writing panels: explicit schemas, pruned columns, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PANEL = "timestamp timestamp_ntz, load double, temp double, btype string, building_id string, hour_sin double, hour_cos double, dow_sin double, dow_cos double"
METADATA = "building_id string, primaryspaceusage string, lat double, timezone string, site_id string"
WEATHER = "timestamp timestamp_ntz, site_id string, airTemperature double"
LABELLED = "building_id string, timestamp timestamp_ntz, meter_reading double, anomaly int"
SELECTION = "building_id string, tag string, completeness double"
EVENTS = "start long, end long, type string, severity int, severity_name string, injected_excess_kwh double, building_id string"


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A CSV file, or all of a folder. Columns are found by name, so files may have others besides
    and in any order; NaN and empty fields are null."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    if not header:
        return spark.read.schema(schema).option("sep", sep).csv(path)
    raw = spark.read.option("header", True).option("sep", sep).option("nanValue", "nan").csv(path)
    out = raw.select(*[F.col(f"`{n}`").try_cast(t).alias(n) for n, t in fields])
    return out.select(*[F.when(~F.isnan(n), F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in fields])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one CSV file per building."""
    return read_csv(spark, path, PANEL)


def write_panel(df: DataFrame, path: str, format: str = "parquet") -> None:
    """A table partitioned by building, so reads of a few buildings touch only theirs."""
    df.write.mode("overwrite").partitionBy("building_id").format(format).option("header", True).save(path)


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A file with a timestamp and one column per building, as (entity, ts, x)."""
    raw = spark.read.option("header", True).csv(path)
    return long_from_wide(raw)


def long_from_wide(raw: DataFrame, time: str = "timestamp") -> DataFrame:
    cols = [c for c in raw.columns if c != time]
    x = raw.select(F.col(time).cast("timestamp_ntz").alias("ts"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in cols])
    x = x.unpivot("ts", [F.col(f"`{c}`") for c in cols], "entity", "x")
    return x.select("entity", "ts", F.when(~F.isnan("x"), F.col("x")).alias("x"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, METADATA)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, WEATHER)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled readings: (entity, ts, x, anomaly)."""
    return read_csv(spark, path, LABELLED).select(F.col("building_id").alias("entity"), F.col("timestamp").alias("ts"), F.col("meter_reading").alias("x"), "anomaly")


def write_selection(df: DataFrame, path: str) -> None:
    df.select("building_id", "tag", "completeness").write.mode("overwrite").option("sep", "\t").csv(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SELECTION, sep="\t", header=False)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An events file, as the interval table of the evaluation operators."""
    e = read_csv(spark, path, EVENTS)
    return e.select(F.col("building_id").alias("entity"), F.xxhash64("building_id", "start", "type").alias("event_id"), "start", "end", "type", "severity", F.col("injected_excess_kwh").alias("true_kwh"))


def write_results(df: DataFrame, path: str, keys: tuple[str, ...] = ("seed",), format: str = "parquet") -> None:
    """Results partitioned by seed: a rerun replaces its own seed's part only, and reading the folder
    is the union of all parts."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(format).save(path)
