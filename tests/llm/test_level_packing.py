import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meterloom.llm import level_packing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_level(counts, size, most):
    """The level of least sum of squares, by trying each; ties to the fullest."""
    tried = []
    for h in [0, *(h for h, n in counts.items() if n and h + size <= most)]:
        after = defaultdict(int, counts)
        after[h] -= h > 0
        after[h + size] += h + size < most
        tried.append((sum(n * n for n in after.values()), -h))
    return -min(tried)[1]


@pytest.mark.parametrize("seed", range(4))
def test_places_by_least_sum_of_squares(seed):
    rng, most = random.Random(seed), 32
    levels, counts = level_packing.LevelArray(most), defaultdict(int)
    for k in range(400):
        size = rng.choice([3, 5, 11, 16, 17, rng.randint(1, 31)])
        h = best_level(counts, size, most)
        assert levels.level_for(size) == h
        full = levels.place(size, (k, 0, size, b"\0" * 4 * size))
        counts[h] -= h > 0
        counts[h + size] += h + size < most
        assert (full is not None) == (h + size == most)
        assert levels.open == sum(counts.values())


def checked(rows, ids, most):
    """Every id of every document in one piece, gapless sequences without padding; returns how many sequences are short."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, got in by_doc.items():
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[d])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[d])
    short = 0
    for got in by_seq.values():
        at = 0
        for r in sorted(got, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= most and at & (at - 1) == 0
        short += at < most
    return short


def test_whole_table(spark):
    rng = random.Random(3)
    texts = [None, "", "word", "a b c " * 3000, "\u4e2d\u6587 " * 50] + [" ".join(rng.choices(["alpha", "beta", "it's", "x1"], k=rng.randint(1, 900))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, length string, sequence_id int").repartition(2)
    tok = Tokenizer.from_file(PATH)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    out = level_packing.pack_online(df, PATH)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    short = checked(out.collect(), ids, 2048)
    assert short <= 2 * 11  # a task's last tokens only
    assert level_packing.pack_online(df.limit(0), PATH).collect() == []


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(7, "same text"), (7, "same text"), (None, "same text"), (None, None)], "doc_id long, text string").coalesce(1)
    rows = level_packing.pack_online(df, PATH).collect()
    assert sum(r["length"] for r in rows) == 3 * 3 + 1
    assert sum(r["start"] == 0 for r in rows) == 4


@pytest.mark.parametrize("sizes", [[17], [31, 1, 16], [1], [19, 13, 27]])
def test_many_open_windows_are_closed(sizes, monkeypatch):
    monkeypatch.setattr(level_packing, "MOST_OPEN", 8)
    docs = [(i, np.arange(i, i + n, dtype="<u4").tobytes()) for i, n in zip(range(200), itertools.cycle(sizes))]
    rows = [r for b in level_packing.packed_batches(iter(docs), 32, 0) for r in b.to_pylist()]
    assert checked(rows, {i: np.frombuffer(b, "<u4").tolist() for i, b in docs}, 32) <= 6
    assert len({r["sequence_id"] for r in rows}) <= sum(len(b) for _, b in docs) / 4 / 32 + 6


def test_most_documents_are_not_cut():
    rng = np.random.default_rng(0)
    docs = [(i, b"\1\0\0\0" * int(n)) for i, n in enumerate(rng.integers(1, 2048, 4000))]
    rows = [r for b in level_packing.packed_batches(iter(docs), 2048, 0) for r in b.to_pylist()]
    assert len(rows) < 1.35 * len(docs)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_any_tokenizer_file(name):
    with open(public_tokenizers.path(name), "rb") as f:
        file = f.read()
    texts = ["It's a Test, of 3 things.", " two  spaces\nand lines ", "caf\u00e9 \u4e2d", "a <|endoftext|> b"]
    own, tok = packing.WordTokenizer(file), Tokenizer.from_buffer(file)
    assert own.by_words == (name == "word_bpe_49k.json")
    assert [np.frombuffer(b, "<u4").tolist() for b in own.ids(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
