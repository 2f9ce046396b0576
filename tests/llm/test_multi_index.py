import math
import random

import numpy as np
import pytest

from meterloom.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cell int"


def plain(rows, positives=5, negatives=3):
    """All scores, sorted: the definition."""
    use = []
    for n, (vec_id, v, label, *_) in enumerate(rows):
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        use.append((n, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    for n, a, label, x in use:
        if a is None or a % 50:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), b, lb) for m, b, lb, y in use if m != n and len(y) == len(x)]
        for s, p, _ in sorted((t for t in scored if t[2] == label), key=order)[:positives]:
            fits = sorted((t for t in scored if t[2] != label and 50 * s <= 100 * t[0] <= 95 * s), key=order)[:negatives]
            out += [(a, p, k + 1, t[1], s, t[0]) for k, t in enumerate(fits)]
    return out


def result(spark, rows):
    df = multi_index.hard_negatives(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    return sorted((tuple(r) for r in df.collect()), key=key), key


@pytest.fixture
def tiny(monkeypatch):
    for name, n in (("BLOCK", 40), ("QUERIES", 3), ("PROBE", 16)):
        monkeypatch.setattr(multi_index, name, n)


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_scores(spark, tiny, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 9))
    rows = []
    for i in range(400):
        v = centres[rng.integers(12)] * rng.choice([0.2, 1.0]) + rng.normal(size=9) * rng.choice([0.02, 0.3])
        rows.append((i * int(rng.choice([1, 5])), v.tolist(), int(rng.integers(10)), "x", 1))
    rows += [(50 * (i + 100), rows[i][1], int(rng.integers(10)), "x", 1) for i in range(20)]
    got, key = result(spark, rows)
    assert len(got) > 50
    assert got == sorted(plain(rows), key=key)


def test_odd_rows_take_no_part_and_copies_are_rows(spark, tiny):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(0, 1) for _ in range(3)], i % 3, "x", 1) for i in range(100)]
    rows += [(50, [0.5, 0.5, 0.5], None, "x", 1), (150, None, 1, "x", 1), (200, [0.1, float("nan"), 0.2], 1, "x", 1), (250, [0.1, None, 0.2], 1, "x", 1), (300, [float("inf"), 0.0, 0.0], 2, "x", 1)]
    rows += [(None, [0.4, 0.4, 0.4], 1, "x", 1), (350, [], 1, "x", 1), (400, [0.0, 0.0, 0.0], 1, "x", 1), (450, [0.3, 0.4], 1, "x", 1), (451, [0.2, 0.4], 1, "x", 1), (452, [0.1, 0.3], 2, "x", 1)]
    rows += [(50, [0.9, 0.8, 0.7], 2, "x", 1)] * 3 + [(500, [1.0, 1.0, 1.0], k % 2, "x", 1) for k in range(8)]
    got, key = result(spark, rows)
    assert got == sorted(plain(rows), key=key)
    assert any(r[0] == 450 for r in got)


def test_one_vector_in_all_rows(spark, tiny):
    rows = [(i, [0.5, -0.25], i % 2, "x", 1) for i in range(300)]
    got, key = result(spark, rows)
    assert got == sorted(plain(rows), key=key) == []  # no score is below 95 % of another
    rows += [(i + 1000, [0.25, -0.25], 3, "x", 1) for i in range(50)]
    got, key = result(spark, rows)
    assert got == sorted(plain(rows), key=key) and got


def test_empty_table(spark):
    assert result(spark, [])[0] == []


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 3, 12)
    index = multi_index.MultiIndex([np.zeros((3, 2)), np.zeros((4, 2))], [np.zeros(3), np.zeros(4)], sizes)
    one, two = rng.normal(size=3), rng.normal(size=4)
    got = list(index.cells(one, two))
    assert sorted(c for _, c in got) == [c for c in range(12) if sizes[c]]
    assert all(math.isclose(b, one[c // 4] + two[c % 4]) for b, c in got)
    assert [b for b, _ in got] == sorted((b for b, _ in got), reverse=True)


def test_bounds_hold_for_every_row(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), 0, "x", 1) for i in range(500)]
    index, placed = multi_index.fitted(multi_index.quantised(spark.createDataFrame(rows, SCHEMA)), 6)
    got = placed.toPandas()
    assert index.sizes.sum() == 500
    x = np.array(got["x"].tolist())
    one, two = index.bounds(x[:20])
    for q in range(20):
        cell = got["cell"].to_numpy()
        assert (x @ x[q] <= one[q][cell // len(two[q])] + two[q][cell % len(two[q])] + 1e-6).all()
