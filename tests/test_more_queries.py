"""Queries that SQL cannot express, by their values: against plain Python on the same draws, or by what must hold."""

import numpy as np
import pandas as pd
import pytest

from meterloom.operators import evaluate as E
from meterloom.operators import inject as I
from meterloom.operators import models as M
from meterloom.operators import panel as P
from meterloom.plans import panels
from meterloom.plans.queries import Q
from meterloom.storage import clear, released, shared_dir, stored

DIR = "/root/testdata/sf0.001"


def test_injection_is_one_pass_and_its_parts_agree(spark):
    """Events, increments and draws of one run; events don't overlap; truth is the sum of increments."""
    rng = np.random.default_rng(0)
    hours = pd.date_range("2024-01-01", periods=3000, freq="h")
    pdf = pd.concat([pd.DataFrame({"entity": e, "idx": range(3000), "ts": hours, "x": 50 + 10 * rng.random(3000)}) for e in "ab"])
    p = P.split(spark.createDataFrame(pdf).withColumn("ts", P.F.col("ts").cast("timestamp_ntz")))
    events, delta, draws = (x.toPandas() for x in I.inject(p, n_events=3))
    assert events.groupby("entity").size().to_dict() == {"a": 3, "b": 3} and draws["accepted"].sum() == 6
    for e in events.itertuples():
        own = delta[(delta.entity == e.entity) & delta.idx.between(e.start, e.end - 1)]
        assert len(own) == e.end - e.start and np.maximum(own.delta, 0).sum() == pytest.approx(e.true_kwh)
    for _, g in events.sort_values("start").groupby("entity"):
        assert (g.start.to_numpy()[1:] >= g.end.to_numpy()[:-1]).all()
    assert len(delta) == (events.end - events.start).sum() and set(draws.reason) <= {"", "overlap", "peak<0.5kW"}


def test_masks_decide_what_a_residual_depends_on():
    """A change of the load before the judged row: no matter to a full mask, seen by the others."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 28, 3))
    x[:, :, 0] += x[:, :, 1]
    m = M.MaskedPatches(width=8, heads=2, layers=1, patch=7, stride=7, hide=0.4, passes=2).fit(x)
    early, last = x.copy(), x.copy()
    early[:, :7, 0] += 3
    last[:, -1, 0] += 3
    assert np.allclose(m.residuals(early)[:, -1], m.residuals(x)[:, -1])
    assert not np.allclose(m.target_residuals(early), m.target_residuals(x)) and not np.allclose(m.open_residuals(early), m.open_residuals(x))
    assert np.allclose(m.target_residuals(last), m.target_residuals(x) + 3) and not np.allclose(m.open_residuals(last), m.open_residuals(x) + 3)


def test_masked_variants_judge_every_row(spark):
    got = Q["masked_variants"](spark, DIR).toPandas()
    n = got.groupby("variant").size()
    assert n.nunique() == 1 and len(n) == 6 and got["x"].notna().all()


def test_alarm_scales_by_hand(spark):
    rows = [("a", i, i in (2, 3, 8, 9), s, l) for i, (s, l) in enumerate([(0, 0), (0, 0), (3, 1), (4, 1), (0, 0), (0, 0), (0, 0), (0, 0), (1, 5), (1, 6)])]
    f = spark.createDataFrame([(e, i, f, float(s), float(l)) for e, i, f, s, l in rows], "entity string, idx long, flag boolean, s double, long double")
    none = spark.createDataFrame([("a", 0, 5, 6)], "entity string, event_id int, start long, end long")
    assert [tuple(r) for r in E.alarm_scales(f, none).collect()] == [("a", 2, 1)]
    hit = spark.createDataFrame([("a", 0, 3, 6)], "entity string, event_id int, start long, end long")
    assert [tuple(r) for r in E.alarm_scales(f, hit).collect()] == [("a", 1, 0)]


def test_temperature_detector_equals_least_squares(spark):
    got = {r["entity"]: r for r in Q["temperature_detector"](spark, DIR).collect()}
    d = panels.daily(spark, DIR)
    from meterloom.functions import calendar as C

    pdf = d.withColumn("temp", C.climate_proxy(P.F.col("ts"), P.F.lit(40.0))).toPandas().sort_values("idx")
    for e, g in pdf.groupby("entity"):
        train = (g.idx < int(len(g) * 0.7)).to_numpy()
        x = np.column_stack([pd.get_dummies(g.slot).to_numpy(float), g.temp, g.temp**2])
        r = g.x.to_numpy() - x @ np.linalg.lstsq(x[train], g.x[train], rcond=None)[0]
        med = np.median(r[train])
        mad = 1.4826 * np.median(np.abs(r[train] - med))
        assert got[e]["n"] == (~train).sum() and got[e]["alarms"] == (np.abs(r[~train] - med) / (mad + 1e-9) > 3.5).sum()


def test_network_alarms_judge_every_test_row(spark):
    got = Q["network_alarms"](spark, DIR).toPandas()
    n = panels.daily(spark, DIR).where("span = 'test'").groupBy("entity").count().toPandas().set_index("entity")["count"]
    assert set(got.weather) == {"measured", "swapped"} and all(r.n == n[r.entity] and 0 <= r.alarms <= r.n for r in got.itertuples())


def test_additive_schedules_compare_the_same_number_of_events(spark):
    got = Q["additive_schedules"](spark, DIR).toPandas()
    # six events for each of the five event types
    assert got.groupby("schedule")["n"].sum().to_dict() == {"additive": 30, "level": 30}


def test_stored_tables_are_deleted(spark):
    import os

    one, two = stored(spark.range(5), "one"), stored(spark.range(5), "two")
    assert os.path.isdir(one._stored_at) and one._stored_at.startswith(shared_dir(spark))
    released(one)
    assert not os.path.exists(one._stored_at) and two.count() == 5


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, k, d):
            return d

    class Context:
        applicationId, master = "app-1", "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_clear_deletes_all(spark):
    import os

    t = stored(spark.range(5), "last")
    clear(spark)
    assert not os.path.exists(t._stored_at) and not os.path.exists(shared_dir(spark))
