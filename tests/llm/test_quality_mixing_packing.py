import math
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterloom.llm import mixing, packing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")


def english(rng, n):
    common = quality.COMMON["en"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(n)) + "."


def plain_base(text):
    ws = set(" \t\n\v\f\r")
    words, cur = [], ""
    for c in text + " ":
        if c in ws:
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if any(c not in ws for c in x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_base_counts_equal_a_plain_count(spark):
    rng = random.Random(0)
    texts = ["", None, "a b c d e a b c d e a b c d e", "x\nx\n\nx \n x", "é ü ß\x1cz\t\v#|<>&", " ", english(rng, 300), "one\r\none\r\n", "w " * 4000, "𝔘𝔫𝔦 " * 30]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    for r in quality.quality_rules(df, ["doc_id"]).collect():
        want = plain_base(texts[r["doc_id"]] or "")
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(1)
    rows = [(i, english(rng, 300), "en", "s", 0) for i in range(60)]
    junk = [(100 + i, " ".join(f"{w}###" for w in english(rng, 300).split()), "en", "s", 0) for i in range(3)]
    junk += [(110 + i, english(rng, 300).upper().replace(" ", "!! "), "en", "s", 0) for i in range(3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + junk], DOCS + ", kept string, n_words int")
    out = quality.drop_low_quality(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [r[0] for r in rows]
    assert quality.drop_low_quality(df.limit(0)).count() == 0


def plain_distance(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda x: sum(v * math.log2(2 * v / (v + w)) for v, w in zip(x, b if x is a else a) if v)
    return math.sqrt(max(0.0, (kl(a) + kl(b)) / 2))


def plain_histograms(text, lang):
    classes, words = [0] * 6, text.encode().split()
    for c in text:
        kind = unicodedata.category(c)
        if c < "\x80":
            k = 3 if c <= " " else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if c in ".,;:!?'\"()-" else 5
        else:
            k = 0 if kind in ("Lu", "Lt") else 1 if kind[0] in "LM" else 2 if kind[0] == "N" else 3 if kind[0] in "ZC" else 4 if kind[0] == "P" else 5
        classes[k] += 1
    common = quality.COMMON.get(lang, [])
    known = [sum(w.decode() == c for w in words) for c in common] + [0] * (20 - len(common))
    return classes, [*known, len(words) - sum(known)]


def test_distances_and_verdicts_equal_plain_ones(spark):
    """References of the documents that pass the base rules, distances to them, and limits by length."""
    rng = random.Random(7)
    rows = [(i, english(rng, rng.randint(5, 300)), rng.choice(["en", "en", "xx", None]), "s", 0) for i in range(60)]
    rows += [(100, "Été «déjà» — ÀÉ “citation” … 😀 ☃ ½ x̄\u00a0y " * 4 + english(rng, 30), "fr", "s", 0), (101, None, "fr", "s", 0), (102, "der die und | # | # | # " + english(rng, 40), "de", "s", 0), (103, "same words " * 50, "en", "s", 0)]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()}
    lang = {i: x if x in quality.COMMON else "other" for i, _, x, _, _ in rows}
    h = {i: plain_histograms(t or "", lang[i]) for i, t, *_ in rows}
    base = {i: plain_base(t or "") for i, t, *_ in rows}
    failed = {i: c[0] < 10 or 100 * c[4] > 20 * c[0] for i, c in base.items()}
    for i, t, *_ in rows:
        same = [j for j in h if lang[j] == lang[i] and not failed[j]]
        d = [plain_distance(h[i][k], [sum(x) for x in zip(*(h[j][k] for j in same))]) for k in (0, 1)]
        r = got[i]
        assert (r["class_distance"], r["word_distance"]) == (pytest.approx(d[0], abs=1e-9), pytest.approx(d[1], abs=1e-9))
        noise = lambda k: math.sqrt((k - 1) / (8 * max(1, base[i][0]) * math.log(2)))
        assert r["kept"] == (not failed[i] and d[0] < noise(6) + quality.CLASS_MARGIN and d[1] < noise(21) + quality.WORD_MARGIN)
    assert failed[103] and not got[103]["kept"]


def water(sizes):
    """Targets by the stated rule, one source at a time."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode("utf-8")) + ([None] if None in sizes else [])
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [k for k in names if k not in full]
        rest, w = total - sum(3 * sizes[k] for k in full), sum(weight[k] for k in free)
        t = {k: 3.0 * sizes[k] if k in full else rest * weight[k] / w for k in names}
        over = {k for k in free if t[k] > 3 * sizes[k]}
        if not over:
            return t
        full |= over


def test_mixing(spark):
    rng = random.Random(2)
    names = ["a", "b", "B", "é", "z", None, "tiny", "hot"]
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), "en", "hot" if rng.random() < 0.4 else rng.choice(names), 0) for i in range(3000)]
    rows += [(90000, "", "en", "empty", 0), (90001, None, "en", "empty", 0), (None, "a b", "en", "a", 0), (7, rows[7][1], "en", rows[7][3], 0)]
    df = spark.createDataFrame(rows, DOCS)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want, taken = water(sizes), {}
    out = mixing.mix(df)[0].collect()
    for r in out:
        assert r["mix_size"] == len((r["text"] or "").split()) and r["mix_source_size"] == sizes[r["source"]]
        assert r["mix_target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["mix_copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix_copies"] * r["mix_size"]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for k, t in want.items():
        assert abs(taken[k] - t) <= max(0.15 * t, 150)
    again = {(r["doc_id"], r["source"]): r["mix_copies"] for r in mixing.mix(df.repartition(7))[0].collect()}
    assert again == {(r["doc_id"], r["source"]): r["mix_copies"] for r in out}
    repeated = mixing.mixed(df)
    assert repeated.columns == df.columns and repeated.count() == sum(r["mix_copies"] for r in out)
    assert mixing.mix(df.limit(0))[0].count() == 0
    clash = df.limit(20).withColumns({"mix_key": F.lit(1), "mix_size": F.lit(2), "a.b": F.lit(3)})
    assert mixing.mixed(clash).columns == clash.columns and {tuple(r)[-3:] for r in mixing.mixed(clash).collect()} == {(1, 2, 3)}


@pytest.mark.parametrize("doc_id", [None, 7])
@pytest.mark.parametrize("same", [False, True])
def test_rows_of_one_id_have_draws_of_their_own(spark, doc_id, same):
    rows = [(doc_id, "one two three four" if same else f"one two three {i}", lang, f"s{i % 2}", 0) for i, lang in enumerate(["en", "de"] * 2000)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for mixed in (mixing.mixed(df), mixing.mixed(df.repartition(2))):
        taken = {r["source"]: 4 * r["count"] for r in mixed.groupBy("source").count().collect()}
        want = {r["source"]: r["mix_target"] for r in mixing.mix(df)[0].select("source", "mix_target").distinct().collect()}
        assert set(taken) == set(want) == {"s0", "s1"} and all(abs(taken[s] - want[s]) <= 0.05 * want[s] for s in want)
    count = lambda d: sorted(map(tuple, d.groupBy("doc_id", "text", "source", "mix_copies").count().collect()), key=str)
    assert count(mixing.mix(df)[0]) == count(mixing.mix(df.repartition(3))[0])


def test_mixing_caps_small_sources(spark):
    rows = [(i, "w " * 50, "en", "big", 0) for i in range(100)] + [(1000 + i, "w " * 2, "en", f"s{i}", 0) for i in range(9)]
    t = {r["source"]: r["mix_target"] for r in mixing.mix(spark.createDataFrame(rows, DOCS))[0].collect()}
    assert t == pytest.approx(water({"big": 5000, **{f"s{i}": 2 for i in range(9)}}))


def test_nnls_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 14)), rng.random(8) * 4 - 1
        x = packing.nnls(a, b)
        grad = a.T @ (b - a @ x)
        assert (x >= 0).all() and grad.max() < 1e-6 and abs(grad[x > 1e-9]).max(initial=0) < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_packed_uses_every_piece_once_and_fills_well(seed):
    rng = np.random.default_rng(seed)
    most = int(rng.choice([64, 512, 4096]))
    n = int(rng.choice([1, 30, 5000]))
    lengths = np.minimum(rng.geometric(4 / most, n), most)
    counts = np.bincount(lengths, minlength=most + 1)
    runs = packing.packed(counts, most, 32)
    used = np.zeros(most + 1, np.int64)
    for r in runs:
        assert r.n > 0 and r.gap >= 0 and sum(x * k for x, k in r.parts) == most - r.gap
        for x, k in r.parts:
            used[x] += k * r.n
    assert (used == counts).all()
    best = -(-int(lengths.sum()) // most)
    assert sum(r.n for r in runs) <= max(best + 1, 1.02 * best)


def test_pack(spark):
    rng = random.Random(3)
    tok = Tokenizer.from_file(PATH)
    texts = [" ".join(rng.choices(["alpha", "Beta", "don't", "x1", "naïve", "…", "Öl"], k=rng.randint(0, 300))) for _ in range(120)]
    texts += ["", None, "word " * 9000, "<|endoftext|> a <|startoftext|>", "ΑΣ ΟΔΟΣ İstanbul 漢字 ﬁ é", "same text"] + ["same text"] * 60 + ["a\x1cb\x85c d", "K Å"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    out = packing.pack(df, PATH).toPandas()
    got = {}
    for r in out.itertuples():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(got[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        for k, r in enumerate(mine):
            assert r.start == 4096 * k and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 4096
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 4096) + 1
    assert packing.pack(df.limit(0), PATH).count() == 0
