"""Streams over several micro-batches with a restart, and the waiting rows of the online detector."""

import datetime as dt
import random

import numpy as np
import pytest

from meterloom.functions import calendar as C
from meterloom.operators import panel as P
from meterloom.plans import panels
from meterloom.streaming.online import Trailing, online_flags

ZERO = dt.datetime(2024, 3, 1)


def rows_of(seed, n=90):
    rng = random.Random(seed)
    return [(e, ZERO + dt.timedelta(hours=i), rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1), 9.0])) for e in ("a", "b") for i in range(n)]


@pytest.mark.parametrize("late, delay", [(150, 3), (40, 1)])
def test_online_flags_in_order_over_batches(spark, tmp_path, late, delay):
    rows = rows_of(late)
    profile = spark.createDataFrame([(e, s, 0.5, 2.0) for e in ("a", "b") for s in range(24)], "entity string, slot int, med double, mad double")
    source = spark.createDataFrame(rows, "entity string, ts timestamp, x double")
    out = panels.drained(spark, "", lambda s: online_flags(s, profile, C.hour_slot, window=20, delay=f"{delay} hours"), "append", source, late=late)
    assert out._batches >= 6
    got = {(r["entity"], r["ts"].replace(tzinfo=None)): r for r in out.collect()}
    last = max(t for _, t, _ in rows) - dt.timedelta(hours=delay)
    assert len(got) == sum(t <= last for _, t, _ in rows) == out.count()
    for e in ("a", "b"):
        judge = Trailing(20)
        for _, t, x in sorted(r for r in rows if r[0] == e and r[1] <= last):
            s = np.nan if x is None else (x - 0.5) / (2.0 + 1e-9)
            mad, z, flag = judge.push(s)
            r = got[e, t]
            assert r["flag"] == flag and (r["z"] is None) == bool(np.isnan(z)) and (r["z"] is None or r["z"] == pytest.approx(z))
            assert (r["s"] is None) == (x is None)


def test_an_empty_stream(spark):
    source = spark.createDataFrame([], "entity string, ts timestamp, x double")
    profile = spark.createDataFrame([("a", 0, 0.0, 1.0)], "entity string, slot int, med double, mad double")
    assert panels.drained(spark, "", lambda s: online_flags(s, profile, C.hour_slot), "append", source).collect() == []


def test_weather_of_sites(spark):
    """Null readings are skipped, the first of an hour in time counts, and of a repeated local hour the earlier."""
    at = lambda d, h, m=0: dt.datetime(2024, 11, d, h, m)
    sites = spark.createDataFrame([("x", "s", 40.0, "America/New_York"), ("y", "s", 40.0, "America/New_York"), ("z", "t", 40.0, "UTC")], "entity string, site_id string, lat double, timezone string")
    weather = [("s", at(3, 4), 1.0), ("s", at(3, 5), None), ("s", at(3, 5), 12.5), ("s", at(3, 6), 99.0), ("s", at(3, 8), 20.0), ("t", at(3, 0), None)]
    weather = spark.createDataFrame(weather, "site_id string, timestamp timestamp_ntz, airTemperature double")
    panel = spark.createDataFrame([(e, i, at(3, i)) for e in "xyz" for i in range(5)], "entity string, idx long, ts timestamp_ntz")
    got = {(r["entity"], r["idx"]): r for r in P.with_weather(panel, sites, weather).collect()}
    # local hours: 0 (4Z), 1 (5Z and 6Z: the earlier), 3 (8Z); 2 is between, 4 comes after
    for e in "xy":
        assert [got[e, i]["temp"] for i in range(5)] == [1.0, 12.5, 16.25, 20.0, 20.0] and all(got[e, i]["measured"] for i in range(5))
    assert not any(got["z", i]["measured"] for i in range(5)) and all(got["z", i]["temp"] is not None for i in range(5))
    assert len(got) == 15
