import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from meterloom.llm import lexical

DOCS, ITEMS = "doc_id long, text string, score string, terms int", "item_id long, text string, rank string, doc_id int"
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def cut(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counted = [(d, Counter(t), len(t)) for d, t in ((r[0], cut(r[1])) for r in docs) if t]
    total, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text, *_ in items:
        found = []
        for d, c, n in counted:
            m = 10 + 90 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k])]
    return out


def result(spark, docs, items):
    df = lexical.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return df.collect()


def same(got, want):
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.fixture
def tiny(monkeypatch):
    for name, n in (("RANGE", 20), ("POSTINGS", 60), ("WIDTH", 3)):
        monkeypatch.setattr(lexical, name, n)


@pytest.mark.parametrize("seed,groups", [(0, 1), (1, 3)])
def test_equals_all_scores(spark, tiny, monkeypatch, seed, groups):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(rng.randint(0, 150), " ".join(rng.choices(words, k=rng.choice([1, 5, 30, 200]))), "x", 1) for _ in range(200)]
    docs += docs[:30]  # repeated rows, ties
    items = [(i % 9, " ".join(rng.choices(words, k=rng.choice([1, 4, 25]))), "x", 1) for i in range(12)]
    if groups > 1:
        monkeypatch.setattr(lexical, "ITEM_TERMS", 60)
    got, want = result(spark, docs, items), plain(docs, items)
    assert len(want) > 60
    same(got, want)


def test_odd_rows(spark):
    docs = [(5, "Café caf\u00c9 ÄB-a1_z\x7f", "x", 1), (None, "b a", "x", 1), (4, "a\u00a0b a\u2003", "x", 1), (3, None, "x", 1), (2, "", "x", 1), (1, " .,- ", "x", 1), (9, "a " * 50_000 + "rare", "x", 1), (-3, "b a", "x", 1), (8, "b a", "x", 1)]
    items = [(1, "A b", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "unknown", "x", 1), (None, "RARE café", "x", 1), (1, "A b", "x", 1), (6, "\u00e4b \u00c4b 1 a1 z", "x", 1)]
    same(result(spark, docs, items), plain(docs, items))


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a", "x", 1)]) == []
    assert result(spark, [(1, "a", "x", 1)], []) == []
    assert result(spark, [(1, None, "x", 1)], [(1, "a", "x", 1)]) == []


def test_many_documents_of_one_score(spark, tiny):
    docs = [(i, "same text here", "x", 1) for i in range(120, 0, -1)] + [(999, "other words", "x", 1)]
    same(result(spark, docs, [(1, "same here", "x", 1)]), plain(docs, [(1, "same here", "x", 1)]))


def test_treap_finds_every_entry():
    rng = np.random.default_rng(0)
    grid = np.where(rng.random((13, 50)) < 0.2, rng.integers(1, 1000, (13, 50)), 0)
    row, column = np.nonzero(grid)
    treap = lexical.Treap(row, column, grid[row, column])
    rows, weights = np.array([1, 4, 12]), np.array([3, 0, 7])
    scores, columns = lexical.descend(treap, rows, weights, 50, 1)
    want = {c: int(s) for c, s in enumerate(weights @ grid[rows]) if s > 0}
    assert dict(zip(columns.tolist(), scores.tolist())) == want
    best, _ = lexical.descend(treap, rows, weights, 5, 1)
    assert best.tolist() == sorted(want.values(), reverse=True)[:5]
    assert [b[0] for b in treap.best[:1]] == [grid.max()]
