import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterloom.llm import embeddings as E
from meterloom.llm import quality
from test_quality_mixing_packing import DOCS, english
from test_ngram_join import brute


def vectors(seed=0, n=400, d=16):
    rng = np.random.default_rng(seed)
    x = [v.tolist() for v in rng.normal(size=(n, d))]
    for c in rng.normal(size=(6, d)):
        x += [(c + rng.normal(size=d) * 0.25).tolist() for _ in range(25)]
    x += [x[0]] * 30 + [(np.array(x[1]) * 1e30).tolist(), (np.array(x[1]) * 1e-30).tolist(), [0.0] * d, [-0.0] * d, None, [], [1.0] * (d - 1), [float("nan")] * d, [float("inf"), *[1.0] * (d - 1)], [None, *[1.0] * (d - 1)]]
    return x


def truth(x, t=0.9):
    d = max(len(v) for v in x if v)
    ok = [v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    u = np.array([np.array(v) / np.abs(v).max() if o else np.zeros(d) for v, o in zip(x, ok)])
    u = u / np.maximum(np.linalg.norm(u, axis=1), 1e-300)[:, None]
    link = u @ u.T >= t
    np.fill_diagonal(link, False)
    lab = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(lab, np.where(link, lab[None], len(x)).min(axis=1))
        if (new == lab).all():
            break
        lab = new
    return link.sum(1), lab


@pytest.mark.parametrize("sizes", [(4096, 1024, 256, 256, 32 << 20), (64, 16, 8, 2, 8192)])
def test_links_equal_brute_force(spark, monkeypatch, sizes):
    for k, v in zip(("LEAST", "CHUNK", "LEAF", "GROUP", "MOST_BYTES"), sizes):
        monkeypatch.setattr(E, k, v)
    x = vectors()
    df = spark.createDataFrame([(i, v, 0, "k") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, key string")
    got = {r["vec_id"]: r for r in E.near_vectors(df).collect()}
    links, lab = truth(x)
    assert len(got) == len(x)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], lab[i], lab[i] == i)


def test_single_precision_vectors_are_compared_in_double(spark):
    x = [np.float32(v).tolist() if v else v for v in vectors(5, 200) if not v or all(c is None or abs(c) < 1e20 for c in v)]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in E.near_vectors(df).collect()}
    links, lab = truth(x)
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(x))] == list(zip(links, lab))


def test_intervals_keep_cores_busy_and_memory_bounded():
    assert E.interval_length(1000, 64, 8) == 4096 and E.interval_length(10**9, 64, 8) == 65536 and E.interval_length(10**9, 1024, 8) == 4096
    n = 100_000
    assert (n / E.interval_length(n, 64, 8)) ** 2 / 2 >= 8


def test_empty_and_unusable(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_vectors(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"], r["n_links"], r["kept"]) for r in E.near_vectors(df).collect()) == [(1, 0, True), (2, 0, True)]


def test_pipeline_equals_its_parts(spark, tmp_path):
    """Each stage against a plain version on its own input."""
    rng = random.Random(5)
    texts = [english(rng, rng.randint(20, 400)) for _ in range(80)]
    texts += [t.replace(t.split()[7], "zzz", 1) for t in texts[:10]] + texts[10:15] + ["too short", "", None]
    texts += [f"{t} write to ann.{i}@mail.example.com or 97.51.17.{i}" for i, t in enumerate(texts[20:30])]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, ["doc_id"]).collect()}
    step = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        step[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    assert ids(step["quality rules"][1]) == [i for i in range(len(texts)) if verdict[i]]
    a, b = step["n-gram jaccard join"]
    own = sorted((r["doc_id"], r["text"]) for r in a.collect())
    _, lab = brute(own)
    assert ids(b) == sorted({own[k][0] for k in lab})
    a, b = step["pii"]
    assert ids(a) == ids(b) and b.where("text LIKE '%mail.example.com%' OR text LIKE '%97.51.17%'").isEmpty()
    a, b = step["mixing"]
    assert set(ids(b)) <= set(ids(a)) and max(r["count"] for r in b.groupBy("doc_id").count().collect()) <= 3
    a, b = step["packing"]
    assert b.where("piece = 0").count() == a.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == b.count()


def test_pipeline_of_nothing_and_of_clashing_columns(spark, tmp_path):
    """No rows; then columns whose names the operators use, which all stages but the last pass unchanged."""
    rng = random.Random(6)
    names = "doc_id long, text string, lang string, source string, n_chars long, kinds string, cls string, `a.b` int, mix_key int, mix_copies int, c0 int, kept int, length int"
    rows = [(i, english(rng, 60), None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", 1, "k", "c", 2, 3, 4, 5, 6, 7) for i in range(30)] + [(None, None, None, None, None, "k", "c", 2, 3, 4, 5, 6, 7)]
    for folder, data in (("none", []), ("some", rows)):
        df = spark.createDataFrame(data, names)
        df.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == df.columns
        assert {tuple(r)[5:] for r in docs.collect()} == {r[5:] for r in data}
        assert corpus_pipeline.run(spark, f"{tmp_path}/{folder}").select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
