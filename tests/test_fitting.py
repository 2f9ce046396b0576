"""Fits on DataFrames against fits on arrays, and the registered detectors' scores from their definition."""

import os

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions import calendar as C
from meterloom.operators import evaluate as E
from meterloom.operators import fitting as FT
from meterloom.operators import models as M
from meterloom.operators import panel as P
from meterloom.operators import windows as W
from meterloom.plans import panels
from meterloom.plans.queries import Q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(f"e{i % 4}", i, *map(float, rng.normal(size=3))) for i in range(600)]
    rows += [("e9", 1, None, 0.0, 0.0), ("e9", 2, float("nan"), 0.0, 0.0)]
    return spark.createDataFrame(rows, "entity string, idx long, a double, b double, c double").repartition(7).persist()


def collected(df):
    """(keys, x) in the keys' order."""
    rows = sorted(df.select("key", "x").collect())
    return np.array([r["key"] for r in rows]), np.array([r["x"] for r in rows])


def test_forest_equals_trees_of_the_least_hashes(spark, points):
    rows = FT.examples(points, COLS)
    forest = FT.fit(points, M.IsolationForest(trees=12, sample=64, seed=3), COLS)
    assert len(forest.forest) == 12
    for t in range(12):
        order = rows.orderBy(F.xxhash64(F.lit("tree"), F.lit(3), F.lit(t), F.col("key"))).limit(64).collect()
        want = M.IsolationForest(trees=12, sample=64, seed=3).tree(np.array([r["x"] for r in order]), 64, t)
        assert all(np.array_equal(a, b) for a, b in zip(forest.forest[t], want))


@pytest.mark.parametrize("sample", ["auto", 256, 0.5])
def test_trees_draw_as_many_rows_as_asked(spark, points, sample):
    forest = FT.fit(points, M.IsolationForest(trees=5, sample=sample), COLS)
    assert {int(size[0]) for *_, size in forest.forest} == {300 if sample == 0.5 else 256}
    x = collected(FT.examples(points, COLS))[1]
    assert np.median(forest.score(np.full((3, 3), 6.0))) > np.quantile(forest.score(x), 0.95)


def test_forest_of_many_rows_draws_from_a_pool(spark):
    big = spark.range(200_000).select(F.lit("e").alias("entity"), F.col("id").alias("idx"), *[(F.xxhash64("id", F.lit(k)) % 1000).cast("double").alias(c) for k, c in enumerate(COLS)])
    forest = M.IsolationForest(trees=4, sample=100)
    taken, m = FT.drawn(FT.examples(big, COLS), forest, 200_000)
    n = {r["tree"]: r["count"] for r in taken.groupBy("tree").count().collect()}
    assert m == 100 and all(100 <= n[t] <= 400 for t in range(4))
    assert taken.agg(F.count_distinct("key")).first()[0] <= 4 * 400


def test_machine_is_that_of_its_sample(spark, points):
    rows = FT.examples(points, COLS)
    got = FT.fit(points, M.OneClassSVM(0.1, most=200, seed=2), COLS)
    order = rows.orderBy(F.xxhash64(F.lit("machine"), F.lit(2), F.col("key")), "key").limit(200)
    want = M.OneClassSVM(0.1, most=200, seed=2).fit(collected(order)[1])
    assert np.allclose(got.x, want.x) and np.allclose(got.a, want.a) and got.rho == pytest.approx(want.rho) and got.g == pytest.approx(want.g)


@pytest.mark.parametrize("fan", [32, 2])
def test_network_equals_the_local_fit(spark, points, monkeypatch, fan):
    monkeypatch.setattr(FT, "FAN", fan)
    got = FT.fit(points, M.Autoencoder((6, 3, 6), passes=6), COLS)
    keys, x = collected(FT.examples(points, COLS))
    want = M.Autoencoder((6, 3, 6), passes=6).fit(x, keys)
    assert all(np.allclose(got.params[k], want.params[k], atol=1e-9) for k in want.params)


@pytest.mark.parametrize("model", [lambda: M.RecurrentAutoencoder(3, passes=4), lambda: M.MaskedPatches(8, 2, 1, patch=4, stride=2, hide=0.4, passes=4), lambda: M.ChannelPatches(8, 2, 1, patch=4, stride=2, passes=4)])
def test_window_network_equals_the_local_fit(spark, points, model):
    series = points.where("entity <> 'e9'").withColumn("idx", F.floor(F.col("idx") / 4).cast("long"))
    windows = M.windows_of(series, COLS, 12, 6)
    got = FT.fit_windows(windows, model())
    keys, x = collected(FT.window_examples(windows))
    want = model().fit(x.reshape(len(x), 12, 3), keys)
    assert len(x) > 60 and all(np.allclose(got.params[k], want.params[k], atol=1e-9) for k in want.params)


def test_training_lowers_the_loss_and_partitions_do_not_matter(spark, points):
    one, many = (FT.fit(points.repartition(n), M.Autoencoder(passes=12), COLS) for n in (1, 9))
    assert all(np.allclose(one.params[k], many.params[k], atol=1e-7) for k in one.params)
    x = collected(FT.examples(points, COLS))[1]
    assert one.score(x).mean() < 0.5 * np.abs(x[:, 0]).mean()


@pytest.mark.parametrize("detector", [M.IsolationForest(3), M.OneClassSVM(), M.Autoencoder((3,), passes=1)])
def test_nothing_to_fit_on_is_an_error(spark, points, detector):
    with pytest.raises(ValueError):
        FT.fit(points.where("entity = 'e9'"), detector, COLS)


def test_repeated_rows_count_each_time(spark, points):
    twice = points.unionByName(points)
    keys, x = collected(FT.examples(twice, COLS))
    got = FT.fit(twice, M.Autoencoder((4,), passes=3), COLS)
    want = M.Autoencoder((4,), passes=3).fit(x, keys)
    assert len(x) == 1200 and all(np.allclose(got.params[k], want.params[k], atol=1e-9) for k in want.params)


@pytest.mark.parametrize("name, make", [("isolation_forest", M.IsolationForest), ("one_class_svm", M.OneClassSVM), ("dense_autoencoder", M.Autoencoder)])
def test_registered_detectors_are_fitted_on_all_rows_without_the_driver(spark, monkeypatch, name, make):
    """Scores equal those of a detector fitted on arrays; no table but models and sums is collected."""
    d = panels.daily(spark, DIR).withColumns(C.cyclic(F.col("ts"))).withColumns({"load": F.col("x"), "temp": C.climate_proxy(F.col("ts"), F.lit(40.0))})
    d = P.scale(d, ["load", "temp"]).withColumns({"load": F.col("z_load"), "temp": F.col("z_temp")})
    rows = FT.examples(d.where("span = 'train'"), M.FEATURES).persist()
    keys, x = collected(rows)
    if name == "isolation_forest":
        model = make()
        m = model.rows_a_tree(len(x))
        draws = [rows.orderBy(F.xxhash64(F.lit("tree"), F.lit(0), F.lit(t), F.col("key"))).limit(m).collect() for t in range(3)]
        trees = [model.tree(np.array([r["x"] for r in draw]), m, t) for t, draw in enumerate(draws)]
    else:
        drawn = rows.orderBy(F.xxhash64(F.lit("machine"), F.lit(0), F.col("key")), "key").limit(5000)
        model = make().fit(collected(drawn)[1]) if name == "one_class_svm" else make().fit(x, keys)
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "toPandas", None)
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(out := collect(self)) or out)
    fitted = []
    monkeypatch.setattr(M, "score", lambda df, detector, *a, f=M.score, **k: fitted.append(detector) or f(df, detector, *a, **k))
    out = Q[name](spark, DIR)
    most = {"isolation_forest": 200, "one_class_svm": 0.1 * len(x), "dense_autoencoder": FT.FAN}[name]
    assert all(len(rows) <= most for rows in seen)
    if name == "isolation_forest":
        assert all(np.array_equal(a, b) for got, want in zip(fitted[0].forest, trees) for a, b in zip(got, want))
        return
    test = collect(d.where("span = 'test'").select("entity", "idx", *M.FEATURES))
    want = dict(zip([(r[0], r[1]) for r in test], model.score(np.array([r[2:] for r in test], float))))
    got = {(r["entity"], r["idx"]): r["s"] for r in collect(out)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_tuning_scores_each_configuration_and_reads_the_events_once(spark):
    rng = np.random.default_rng(5)
    loads = {e: rng.normal(size=200) for e in ("a", "b", None)}
    for x in loads.values():
        x[120:126] += 9
    rows = spark.createDataFrame([(e, i, float(v), float(np.sin(i))) for e, x in loads.items() for i, v in enumerate(x)], "entity string, idx long, load double, other double").persist()
    asked, scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    class Counted(M.IsolationForest):
        def score(self, x):
            scored.add(len(x))
            return M.IsolationForest.score(self, x)

    schema = "entity string, event_id int, start long, end long, type string, severity int, true_kwh double"
    plain = spark.createDataFrame([(e, k, s, s + 6, "spike", 1, 1.0) for e in loads for k, s in enumerate((120, 160))], schema)
    grid = [lambda n=n: Counted(n, 64) for n in (3, 20, 8)]
    best, got = FT.tune(rows, rows, plain.mapInArrow(count, schema), grid, ["load", "other"], 60)
    assert (asked.value, scored.value) == (6, 3 * 600)
    want = []
    for make in grid:
        s = M.score(rows, FT.fit(rows, make(), ["load", "other"]), ["load", "other"])
        want.append(E.micro_f1(W.trailing_flags(s, window=60), plain).first()["micro_f1"])
    assert got == want and best == want.index(max(want)) and max(want) > 0


def test_every_core_gets_examples(spark, points, monkeypatch):
    """A pass over few bytes is work for all cores, and the fit is the same."""
    parts, run = [], FT.gradient_pass
    monkeypatch.setattr(FT, "gradient_pass", lambda rows, n, *how: parts.append(n) or run(rows, n, *how))
    got = FT.fit(points.coalesce(1), M.Autoencoder((4,), passes=2), COLS)
    keys, x = collected(FT.examples(points, COLS))
    want = M.Autoencoder((4,), passes=2).fit(x, keys)
    assert min(parts) >= spark.sparkContext.defaultParallelism
    assert all(np.allclose(got.params[k], want.params[k], atol=1e-9) for k in want.params)
