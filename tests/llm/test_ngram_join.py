import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.llm import ngram_join as N
from meterloom.llm.common import components
from meterloom.llm.shingles import bands_for

WORDS = [f"w{i}" for i in range(400)]


def shingles(t):
    w = (t or "").encode().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs, t=0.8):
    sets = [shingles(x) for _, x in docs]
    n = len(docs)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                link[i, j] = link[j, i] = both >= t * (len(sets[i]) + len(sets[j]) - both)
    lab = np.arange(n)
    for _ in range(n):
        lab = np.minimum(lab, np.where(link, lab[None], n).min(axis=1))
    return link.sum(1), lab


def corpus(seed=0, groups=12, size=6):
    rng = random.Random(seed)
    docs = []
    for _ in range(groups):
        base = rng.choices(WORDS, k=rng.randint(20, 150))
        for _ in range(size):
            x = list(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(WORDS)
            docs.append(" ".join(x))
    docs += ["", None, "a b", "a b", "one two three four five", "  ", "x" * 50_000, " ".join(rng.choices(WORDS, k=20_000))]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_near_duplicates_equal_brute_force(spark):
    docs = corpus()
    got = {r["doc_id"]: r for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    links, lab = brute(docs)
    assert len(got) == len(docs)
    for i, _ in docs:
        assert (got[i]["n_links"], got[i]["component_id"]) == (links[i], lab[i])


def test_blocks_give_the_same(spark, monkeypatch):
    docs = corpus(1, groups=3, size=40)
    monkeypatch.setattr(N, "BLOCK_CLASSES", 8)
    got = {r["doc_id"]: r for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    links, lab = brute(docs)
    for i, _ in docs:
        assert (got[i]["n_links"], got[i]["component_id"]) == (links[i], lab[i])


def test_drop_keeps_one_of_each_group(spark):
    docs = corpus(2)
    extra = [(i, t, "k", 1) for i, t in docs] + [(0, docs[0][1], "k", 2), (None, docs[1][1], "k", 3), (None, "only one with no id at all", "k", 4)]
    df = spark.createDataFrame(extra, "doc_id long, text string, cls string, bands int")
    out = N.drop_near_duplicates(df)
    assert out.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    _, lab = brute(docs)
    words = {i for i, t in docs if (t or "").split()}
    want = {int(lab[i]) for i in words} | {i for i, t in docs if not (t or "").split()}
    assert sorted(i for i, _ in kept if i is not None) == sorted(want)
    assert [t for i, t in kept if i is None] == ["only one with no id at all"]


def test_drop_passes_columns_of_any_name(spark):
    docs = [(1, "a b c d e f g", 1, 2, 3), (2, "a b c d e f g", 4, 5, 6), (3, None, 7, 8, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, `a.b` int, __nj_h int, __page int")
    out = N.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(r[0] for r in out.collect()) == [1, 3]
    assert {tuple(r) for r in out.collect()} == {docs[0], docs[2]}


def test_sieve_lets_all_its_keys_through_and_few_others(spark):
    from meterloom.llm.common import sieve, sifted

    keys = spark.range(3000).select((F.xxhash64("id")).alias("key"))
    through = sieve(keys)
    df = spark.range(20_000).withColumn("__at", F.lit(1))
    inside = {r[0] for r in sifted(df, F.xxhash64("id"), through).collect()}
    outside = {r[0] for r in sifted(df, F.xxhash64("id"), through, inside=False).collect()}
    assert inside >= set(range(3000)) and len(inside) < 3600 and inside | outside == set(range(20_000)) and not inside & outside


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0
    assert N.drop_near_duplicates(df).count() == 0


def test_bands():
    b, r = bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999
    assert 1 - (1 - 0.4**r) ** b <= 0.2


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in got} and set(got) == {x for e in edges for x in e}
