"""Round trips of the panel sources."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meterloom.sources import panels as S


def test_panel_csv_and_parquet(spark, tmp_path):
    ts = pd.date_range("2016-01-01", periods=50, freq="h")
    angles = {"hour_sin": 0.5, "hour_cos": 0.5, "dow_sin": 0.1, "dow_cos": -0.1}
    two = pd.concat([pd.DataFrame({"timestamp": ts, "load": np.linspace(1, k, 50), "temp": 20.25, "btype": "office", "building_id": b, **angles}) for k, b in ((7, "B01"), (9, "B07"))], ignore_index=True)
    (tmp_path / "csv").mkdir()
    for b, g in two.groupby("building_id"):
        g[g.columns[::-1]].assign(extra=1).to_csv(tmp_path / "csv" / f"{b}.csv", index=False)
    got = S.read_panel(spark, f"{tmp_path}/csv")
    back = got.toPandas().sort_values(["building_id", "timestamp"], ignore_index=True)
    assert np.allclose(back["load"], two.sort_values(["building_id", "timestamp"])["load"])
    S.write_panel(got, f"{tmp_path}/table")
    again = spark.read.parquet(f"{tmp_path}/table").where("building_id = 'B07'")
    assert again.count() == 50 and "PartitionFilters: [isnotnull(building_id" in again._jdf.queryExecution().toString()


def test_wide_meters(spark, tmp_path):
    pd.DataFrame({"timestamp": ["2016-01-01 00:00:00", "2016-01-01 01:00:00"], "A.x": [1.5, None], "B": [2, 3]}).to_csv(tmp_path / "w.csv", index=False)
    got = {(r["entity"], r["ts"].hour): r["x"] for r in S.read_wide(spark, f"{tmp_path}/w.csv").collect()}
    assert got == {("A.x", 0): 1.5, ("A.x", 1): None, ("B", 0): 2.0, ("B", 1): 3.0}


def test_selection_and_results(spark, tmp_path):
    sel = spark.createDataFrame([("s_office_A", "office", 1.0), ("s_retail_B", "retail", 0.97)], S.SELECTION)
    S.write_selection(sel, f"{tmp_path}/sel")
    assert sorted(map(tuple, S.read_selection(spark, f"{tmp_path}/sel").collect())) == sorted(map(tuple, sel.collect()))
    for seed, f1 in ((1, 0.5), (2, 0.6), (1, 0.7)):
        S.write_results(spark.createDataFrame([(seed, f1)], "seed int, f1 double"), f"{tmp_path}/res")
    assert {(r["seed"], r["f1"]) for r in spark.read.parquet(f"{tmp_path}/res").collect()} == {(1, 0.7), (2, 0.6)}


def test_labels_and_missing_values(spark, tmp_path):
    (tmp_path / "l.csv").write_text("building_id,timestamp,meter_reading,anomaly\n1,2016-01-01 00:00:00,,0\n1,2016-01-01 01:00:00,nan,1\n1,2016-01-01 02:00:00,4.5,1\n")
    got = S.read_labelled(spark, f"{tmp_path}/l.csv").orderBy("ts").collect()
    assert [r["x"] for r in got] == [None, None, 4.5] and [r["anomaly"] for r in got] == [0, 1, 1]
