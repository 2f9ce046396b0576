"""Registered queries on small tables of their own, against plain Python: no row may be left out."""

import numpy as np
import pandas as pd
import pytest

from meterloom.operators import fitting as FT
from meterloom.operators import models as M
from meterloom.plans import panels
from meterloom.plans.queries import Q

DIR = "/root/testdata/sf0.001"


def test_correlation_takes_every_order(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 400
    li = pd.DataFrame({"l_orderkey": np.arange(n), "l_returnflag": rng.choice(["A", "N", "R"], n), "l_quantity": rng.integers(1, 20, n).astype(float)})
    li["l_extendedprice"] = li["l_quantity"] * 7 + rng.integers(0, 90, n)
    spark.createDataFrame(li).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["l_returnflag"]: r for r in Q["correlation_slope"](spark, str(tmp_path)).collect()}
    assert set(got) == {"A", "N", "R"}
    for flag, g in li.groupby("l_returnflag"):
        x, y, r = g["l_quantity"], g["l_extendedprice"], got[flag]
        slope, intercept = np.polyfit(x, y, 1)
        assert r["n"] == len(g)
        assert r["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
        assert r["spearman"] == pytest.approx(np.corrcoef(x.rank(), y.rank())[0, 1], abs=1e-6)
        assert (r["slope"], r["intercept"]) == (pytest.approx(slope, abs=1e-4), pytest.approx(intercept, abs=1e-3))


def test_sessions_of_every_user(spark, tmp_path):
    rng, zero = np.random.default_rng(1), pd.Timestamp("2024-01-01")
    ev = pd.DataFrame({"user_id": rng.integers(1, 40, 600), "minute": rng.integers(0, 2880, 600)})
    ev["ts"] = zero + pd.to_timedelta(ev["minute"], "min")
    spark.createDataFrame(ev).write.parquet(f"{tmp_path}/events.parquet")
    want, closed = [], ev["minute"].max() - 60  # the watermark
    for user, g in ev.groupby("user_id"):
        at = sorted(g["minute"])
        cuts = [0, *(i for i in range(1, len(at)) if at[i] - at[i - 1] > 30), len(at)]  # windows that touch are one session
        want += [(user, j - i, str(zero + pd.Timedelta(at[i], "min"))) for i, j in zip(cuts, cuts[1:]) if at[j - 1] + 30 <= closed]
    got = [tuple(r) for r in Q["stream_sessions"](spark, str(tmp_path)).select("user_id", "n", "start").collect()]
    assert sorted(got) == sorted(want)


def test_tuning_tries_every_configuration(spark, monkeypatch):
    assert {k: len(g) for k, g in M.GRIDS.items()} == {"isolation forest": 9, "one-class svm": 6, "autoencoder": 2, "recurrent autoencoder": 2}
    few = {"isolation forest": [lambda: M.IsolationForest(5), lambda: M.IsolationForest(9, "auto")], "recurrent autoencoder": [lambda: M.RecurrentAutoencoder(4, passes=1)]}
    monkeypatch.setattr(M, "GRIDS", few)
    got = Q["tuned_detectors"](spark, DIR).collect()
    assert [(r["detector"], r["configuration"]) for r in got] == [("isolation forest", "trees=5, sample=256"), ("isolation forest", "trees=9, sample=auto"), ("recurrent autoencoder", "hidden=4")]
    assert sum(r["chosen"] for r in got) == 2 and all(0 <= r["micro_f1"] <= 1 for r in got)


def test_tuning_reads_the_orders_before_it_fits(spark, monkeypatch):
    """What every configuration is fitted and judged on are stored tables, not plans over the orders."""
    seen = []

    def tune(train, val, events, grid, *how):
        seen.extend(f for t in (train, val, events) for f in t.inputFiles())
        return 0, [0.0] * len(grid)

    monkeypatch.setattr(FT, "tune", tune)
    Q["tuned_detectors"](spark, DIR)
    assert seen and not [f for f in seen if "orders" in f]
