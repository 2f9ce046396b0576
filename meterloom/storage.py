"""Intermediate tables in the folder that driver and executors share: they cut lineage, survive the loss of
executors, and give later joins plain scans that adaptive execution can split."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder within ``spark.checkpoint.dir``. Where that is unset, a local session
    (tests) gets a temporary folder; a cluster's executors would not see one, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="meterloom-")
    return f"{found.rstrip('/')}/meterloom/{app}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(*tables: DataFrame) -> None:
    """Delete stored tables (as ``stored`` returned them) that no plan reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._stored_at)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application stored: once the results of its queries have been used."""
    _delete(spark, shared_dir(spark))
