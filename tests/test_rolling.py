"""The ordered window against sorting, and rolling medians against their definition."""

import random
import statistics
import time

import pytest

from meterloom.operators import rolling as R
from meterloom.operators import windows as W

ROWS = "entity string, idx long, s double, __x string, med_ int"


def plain(values, window, least, lag=0, ahead=0):
    """(median, median deviation) of each row, by sorting each frame."""
    n = len(values)
    p = [None] * min(lag, n) + values[: n - lag]
    frame = lambda c, t: [v for v in c[max(0, t + ahead - window + 1) : t + ahead + 1] if v is not None]
    middle = lambda f: statistics.median(f) if f and len(f) >= least else None
    med = [middle(frame(p, t)) for t in range(n)]
    dev = [abs(v - m) if v is not None and m is not None else None for v, m in zip(p, med)]
    return list(zip(med, [middle(frame(dev, t)) for t in range(n)]))


@pytest.mark.parametrize("seed", range(4))
def test_sorted_window_is_a_sorted_list(seed, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 4)
    rng, window, held = random.Random(seed), R.SortedWindow(), []
    for _ in range(600):
        if held and rng.random() < 0.45:
            v = rng.choice(held)
            held.remove(v)
            window.remove(v)
        else:
            v = rng.choice([rng.random(), rng.randint(0, 5), float("inf"), -0.0, 0.0])
            held.append(v)
            window.add(v)
        if held:
            assert window.median() == statistics.median(held) and window.size == len(held)
        assert [v for b in window.blocks for v in b] == sorted(held)


@pytest.mark.parametrize("window, least, lag, ahead", [(7, 2, 1, 0), (7, 2, 0, 0), (8, 3, 0, 3), (7, 1, 0, 3), (50, 12, 1, 0), (50, 12, 0, 24), (1, 1, 0, 0), (5, 6, 0, 0)])
def test_equals_sorting_each_frame(spark, window, least, lag, ahead):
    rng = random.Random(window + lag)
    series = {f"e{k}": [rng.choice([None, rng.gauss(0, 1), rng.randint(0, 3) * 1.0, 2.5]) for _ in range(n)] for k, n in enumerate((1, 2, 30, 200))}
    series["none"] = [None] * 20
    series[None] = [float(i % 7) for i in range(40)]
    rows = [(e, i, v, "x", 1) for e, vs in series.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    df = R.rolling_median_mad(spark.createDataFrame(rows, "entity string, idx long, s double, other string, med_ int"), "s", window, least, lag, ahead)
    assert df.columns == ["entity", "idx", "s", "other", "med_", "__med", "__mad"]
    got = {}
    for r in df.collect():
        got[r["entity"], r["idx"]] = (r["__med"], r["__mad"])
    assert len(got) == len(rows)
    for e, vs in series.items():
        for i, want in enumerate(plain(vs, window, least, lag, ahead)):
            assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-12)) for a, b in zip(got[e, i], want)), (e, i)


def test_entities_that_span_batches(spark):
    rows = spark.range(9000).selectExpr("concat('e', id % 2) AS entity", "id AS idx", "cast(hash(id) % 100 AS double) AS s")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
        got = sorted(tuple(r) for r in R.rolling_median_mad(rows, "s", 100, 25, 0, 49).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for e in ("e0", "e1"):
        own = [r for r in got if r[0] == e]
        assert [(m, d) for *_, m, d in own] == plain([r[2] for r in own], 100, 25, 0, 49)


def test_empty_table(spark):
    assert W.trailing_flags(spark.createDataFrame([], "entity string, idx long, s double")).count() == 0


def test_cost_hardly_depends_on_the_window():
    rng = random.Random(0)
    values = [rng.gauss(0, 1) for _ in range(30_000)]

    def seconds(window):
        best = float("inf")
        for _ in range(3):
            state, t = R.MedianAndDeviation(window, window // 4, 1), time.process_time()
            for v in values:
                for _ in state.push(v):
                    pass
            best = min(best, time.process_time() - t)
        return best

    assert seconds(672) < 2 * seconds(168)
