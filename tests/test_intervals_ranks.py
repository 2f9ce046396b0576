"""Binned interval joins and distributed ranks against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from meterloom.operators import intervals as IV
from meterloom.operators import stats as X

ROWS, INTERVALS = "entity string, idx long, note string", "entity string, start long, end long, name string"


def made(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), i, f"n{i}") for i in range(-40, 400)]
    iv = [(rng.choice(["a", "b", "c", None]), s, s + rng.choice([0, -3, 1, 2, 7, 16, 17, 300]), f"i{k}") for k, s in enumerate(rng.choices(range(-60, 420), k=60))]
    return rows, [*iv, *iv[:5]]


@pytest.mark.parametrize("width", [1, 16, 256])
def test_rows_in_intervals(spark, width):
    rows, iv = made(width)
    r, v = spark.createDataFrame(rows, ROWS), spark.createDataFrame(iv, INTERVALS)
    holds = lambda a, b: a[0] is not None and a[0] == b[0] and b[1] <= a[1] < b[2]
    key = lambda t: tuple(str(x) for x in t)
    got = IV.rows_in(r, v, width=width).select("idx", "note", "start", "end", "name").collect()
    assert sorted(map(tuple, got), key=key) == sorted(((a[1], a[2], b[1], b[2], b[3]) for a in rows for b in iv if holds(a, b)), key=key)
    for how, want in (("left_semi", True), ("left_anti", False)):
        got = IV.rows_in(r, v, how, width)
        assert got.columns == ["entity", "idx", "note"]
        assert sorted(map(tuple, got.collect()), key=key) == sorted((a for a in rows if any(holds(a, b) for b in iv) == want), key=key)


@pytest.mark.parametrize("width", [1, 16, 256])
def test_shared_rows(spark, width):
    _, iv = made(width + 1)
    own = [(e, s, t, n) for e, s, t, n in iv[:30] if e is not None]
    got = {(r["entity"], r["start"], r["end"]): r["shared"] for r in IV.shared_rows(spark.createDataFrame(own, INTERVALS), spark.createDataFrame(iv[30:], INTERVALS), width).collect()}
    assert got == {(e, s, t): sum(any(e == b[0] and b[1] <= i < b[2] for b in iv[30:]) for i in range(s, t)) for e, s, t, _ in own}


def test_a_long_interval_is_a_few_rows(spark):
    year = spark.createDataFrame([("a", 100, 8884, "x")], INTERVALS)
    assert IV._binned(year, IV.WIDTH).count() == 35


def ranks(values):
    return {v: (sum(w < v for w in values) + sum(w <= v for w in values) + 1) / 2 for v in values}


@pytest.mark.parametrize("parts", [1, 7])
def test_mid_ranks_of_few_keys(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["x", "y", None]), rng.choice([1.0, 2.5, -3.0, float(rng.randint(0, 400)), 7.0, 7.0])) for _ in range(900)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["v"]): (r["n"], r["mid"], r["off"]) for r in X.mid_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k in ("x", "y", None):
        own = [v for q, v in rows if q == k]
        want |= {(k, v): (own.count(v), m, m - (len(own) + 1) / 2) for v, m in ranks(own).items()}
    assert got == want


def test_correlation_and_signed_ranks(spark):
    rng = random.Random(9)
    rows = [("a" if i % 3 else None, float(rng.randint(0, 20)), rng.choice([None, float(rng.randint(-5, 5))])) for i in range(300)] + [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("d", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    for r in X.correlation(df, "x", "y", ["k"]).collect():
        own = [(x, y) for k, x, y in rows if k == r["k"] and y is not None]
        assert r["n"] == len(own)
        rx, ry = ranks([x for x, _ in own]), ranks([y for _, y in own])
        a, b = [rx[x] for x, _ in own], [ry[y] for _, y in own]
        mx, my = sum(a) / len(a), sum(b) / len(b)
        cov, va, vb = (sum(p * q for p, q in zip(u, v)) for u, v in (([p - mx for p in a], [q - my for q in b]), ([p - mx for p in a],) * 2, ([q - my for q in b],) * 2))
        assert r["spearman"] == (pytest.approx(cov / (va * vb) ** 0.5) if va * vb else None)
    d = df.withColumn("d", F.col("x") - 10)
    for r in X.signed_rank(d, ["k"]).collect():
        own = [x - 10 for k, x, _ in rows if k == r["k"] and x != 10]
        rk = ranks([abs(v) for v in own])
        assert (r["n"], r["w_plus"]) == (len(own), sum(rk[abs(v)] for v in own if v > 0))


def test_nothing_to_rank(spark):
    assert X.mid_ranks(spark.createDataFrame([], "k string, v double"), ["k"], "v").collect() == []
