"""Language-model scores against the model's definition, one token at a time."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterloom.llm import lm

DOCS = "doc_id long, text string, source string"


def corpus():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(300):
        x, t = rng.choice(words), []
        for _ in range(rng.randint(0, 40)):
            t.append(x)
            x = words[(words.index(x) * 7 + rng.randint(0, 2)) % 60] if rng.random() < 0.8 else rng.choice(words)
        docs.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in t)))
    docs += [(1000, None), (1001, ""), (1002, "É é"), (None, "w1 w2"), (5, docs[5][1]), (1003, "new words only")]
    return docs


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def plain_scores(docs, m):
    """The model by its definition; m: prior weights of contexts of 1, 2, ... words."""
    order = len(m) + 1
    count = Counter()
    for i, t in docs:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            w = tokens(t)
            count.update(tuple(w[j : j + k]) for k in range(1, order + 1) for j in range(len(w) - k + 1))
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)

    def p(w, h):
        if not h:
            return (count[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        return (count[(*h, w)] + m[len(h) - 1] * p(w, h[1:])) / (count[h] + m[len(h) - 1])

    out = []
    for _, t in docs:
        w = tokens(t)
        base = sum(math.log10(p(x, ())) for x in w)
        score = sum(math.log10(p(x, tuple(w[max(0, i - order + 1) : i]))) for i, x in enumerate(w))
        out.append((len(w), sum(count[(x,)] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("m", [(), (20.0,), (20.0, 5.0), (20.0, 5.0, 3.0)])
@pytest.mark.parametrize("block,keys", [(1_000_000, 1_000_000), (200, 150)])
def test_scores_equal_the_definition(spark, monkeypatch, block, keys, m):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", keys)
    docs = corpus()
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], DOCS).repartition(3)
    got = sorted((r for r in lm.score(df, len(m) + 1, m).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"]))
    want = sorted(zip([d[0] for d in docs], plain_scores(docs, m)), key=lambda x: (x[0] is None, x[0], x[1][0]))
    assert len(got) == len(want)
    for r, (i, w) in zip(got, want):
        assert r["doc_id"] == i and (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3], rel=1e-9) and r["score"] == pytest.approx(w[4], rel=1e-9)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 10 == 0)


def test_fitted_priors_are_the_best_of_the_grid(spark, monkeypatch):
    """The prior weights by leave-one-out, each level's after the one below; blocks don't matter."""
    docs = corpus()
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], DOCS)
    count = Counter()
    train = [tokens(t) for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 10]
    for w in train:
        count.update(tuple(w[j : j + k]) for k in (1, 2, 3) for j in range(len(w) - k + 1))
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)

    def p(g, m):
        if len(g) == 1:
            return (count[g] - 1 + 0.1) / (n - 1 + 0.1 * (v + 1))
        return (count[g] - 1 + m[len(g) - 2] * p(g[1:], m)) / (count[g[:-1]] - 1 + m[len(g) - 2])

    m = []
    for k in (2, 3):
        m.append(max(lm.GRID, key=lambda x: sum(math.log10(p(tuple(w[j : j + k]), [*m, x])) for w in train for j in range(len(w) - k + 1))))
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(df).collect()}
    for (i, t), w in zip(docs, plain_scores(docs, m)):
        assert got[i, w[0]] == pytest.approx(w[4], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_the_model_beats_the_base_on_held_out_texts(spark, order):
    df = spark.createDataFrame([(i, t, "s") for i, t in corpus()], DOCS)
    s = lm.score(df, order).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


def test_messages_are_at_most_one_for_each_distinct_ngram(spark, monkeypatch):
    """However many buckets there are."""
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 200)
    df = spark.createDataFrame([(i, t, "s") for i, t in corpus()], DOCS)
    rows = [r.asDict() for r in lm.blocks_of(df).collect()]
    for r in rows:
        b = lm.Block(r, 2)
        for k in (1, 2):
            sent = b.requests(k, 1 << 30)
            assert len(sent) <= len(b.grams[k].own) == sum(len(lm._unsqueeze(x[3], "<u8")) for x in sent)


def test_lm_of_nothing(spark):
    assert lm.score(spark.createDataFrame([], DOCS)).count() == 0
    assert lm.score(spark.createDataFrame([(1, None, None)], DOCS)).count() == 1
