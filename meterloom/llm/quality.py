"""Quality rules: exact base counts, then the divergence of a document from its language.

Each document gets two histograms: of character classes (upper case, lower case and other letters, digit,
blank, sentence mark, symbol; beyond ASCII by Unicode category) and of common words (each word of its
language's list, one bin for the other words). The references are the sums of these histograms over all
documents of the language that pass the base rules, so junk of that kind does not shift them; they are a
table of a few rows (languages not listed share one reference). A document is compared with its reference by Jensen-Shannon distance (base 2, 0 to 1). The limit falls with the
number of words: a sample of n words from k bins is sqrt((k - 1) / (8 n ln 2)) away from its own
source by noise alone, and the limit is that plus a margin. (Characters come in words, so words are what is
drawn there too.) Short texts are judged like long ones, with the larger limits that they need.

Nulls: a null text is the empty text; a null doc_id is kept; a null or unknown language uses the
reference of all such documents. Repeated rows are judged alike. An empty table gives no rows. Very long
texts are read whole. Columns of other names, whatever they are, pass unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored
from .shingles import Words, mix

# Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that for it was on with as be by at this are from".split(),
    "fr": "de la le et les des en un une du est que dans qui par pour au sur pas avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los del se las por un para con una su al es lo".split(),
}
OTHER = "other"

#: A document fails from this distance beyond the noise on.
CLASS_MARGIN, WORD_MARGIN = 0.19, 0.135

_HASHES = {x: np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in v), np.uint64, len(v)) for x, v in COMMON.items()}

# The class of each ASCII character: 0 upper, 1 lower and other letters, 2 digit, 3 blank, 4 sentence
# mark, 5 symbol; other characters are counted apart.
_CLASS = np.full(128, 5)
_CLASS[:0x21] = 3
_CLASS[0x41:0x5B] = 0
_CLASS[0x61:0x7B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[list(b".,;:!?'\"()-")] = 4
_MEMBER = np.zeros((256, 6), np.int64)
_MEMBER[np.arange(128), _CLASS] = 1
_BEYOND = re.compile(rb"[\x80-\xff]+")


def class_of(c: str) -> int:
    """The class of a character beyond ASCII. Marks that are written over letters are letters."""
    kind = unicodedata.category(c)
    return 0 if kind in ("Lu", "Lt") else 1 if kind[0] in "LM" else 2 if kind[0] == "N" else 3 if kind[0] in "ZC" else 4 if kind[0] == "P" else 5


_SPACE, _SYMBOLS = list(b" \t\n\v\f\r"), list(b"#*$%&|<>")


def repeated_words(hashes: np.ndarray, n: int = 5) -> int:
    """Words that lie in an n-word window found twice or more."""
    k = len(hashes) - n + 1
    if k < 2:
        return 0
    with np.errstate(over="ignore"):
        h = np.zeros(k, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + k]
    h = mix(h)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    hit = np.zeros(k, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.nonzero(hit)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Text:
    """A text's words (runs of bytes other than the six blanks), their hashes, and its bytes' counts."""

    def __init__(self, text: bytes, words: Words):
        self.text, self.words = text, text.split()
        self.hashes = words.of(self.words)
        self.often = np.bincount(np.frombuffer(text, np.uint8), minlength=256)

    def chars(self) -> int:
        return len(self.text) - int(self.often[0x80:0xC0].sum())

    def base_counts(self) -> tuple[int, int, int, int, int]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        lines = Counter(x for x in self.text.split(b"\n") if x.strip())
        return (
            len(self.words),
            self.chars() - int(self.often[_SPACE].sum()),
            int(self.often[_SYMBOLS].sum()),
            sum(lines.values()) - len(lines),
            repeated_words(self.hashes),
        )

    def histograms(self, lang: str) -> np.ndarray:
        """Counts of 6 character classes, then of 20 common words and of all other words."""
        out = np.zeros(6 + 21, np.int64)
        out[:6] = self.often @ _MEMBER
        if self.often[0x80:].any():
            for c, n in Counter(b"".join(_BEYOND.findall(self.text)).decode("utf-8", "replace")).items():
                out[class_of(c)] += n
        if lang in _ORDER:
            order, known = _ORDER[lang]
            at = np.minimum(np.searchsorted(known, self.hashes), len(known) - 1)
            out[6 + order] = np.bincount(at[known[at] == self.hashes], minlength=len(known))
        out[-1] = len(self.words) - out[6:-1].sum()
        return out


_ORDER = {x: (np.argsort(h), np.sort(h)) for x, h in _HASHES.items()}


def noise(bins: int, n: Column) -> Column:
    """The expected distance of a sample of n >= 1 from its source (to first order in 1 / n)."""
    return F.sqrt(F.lit(bins - 1) / (F.greatest(n, F.lit(1)) * 8 * float(np.log(2))))


def js_distance(p: Column, q: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of an array of counts from shares; 0 if either is
    empty."""
    total = F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)
    if sum(q) == 0:
        return F.lit(0.0)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(F.transform(p, lambda x: x / total), F.array(*[F.lit(float(x / sum(q))) for x in q]), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))).otherwise(0.0)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` of each document, its language, counts, base verdict and histograms; and the
    names that these have (with underscores after them where ``docs`` has such a column)."""
    new = {c: fresh(docs, c) for c in ("lang", "text", *COUNTS, "base_failed", "histograms")}
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = [f"c{i}" for i in range(len(keep))]  # any name may be kept
    types = {f.name: f.dataType for f in docs.schema.fields}
    source = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)], F.col("text").cast("binary").alias("read_text"), F.when(lang.isin(*COMMON), lang).otherwise(OTHER).alias("read_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(200_000)
        for batch in batches:
            rows, hists = [], np.zeros((batch.num_rows, 27), np.int64)
            text, langs = batch.column(len(own)), batch.column(len(own) + 1)
            for i in range(batch.num_rows):
                t = Text(text[i].as_py() or b"", words)
                counts = t.base_counts()
                rows.append((*counts, counts[0] < 10 or 100 * counts[-1] > 20 * counts[0]))
                hists[i] = t.histograms(langs[i].as_py())
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(own))), langs, *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.bool_()), pa.ListArray.from_arrays(np.arange(0, hists.size + 1, 27, dtype=np.int32), hists.ravel())],
                names=[*own, "lang", *COUNTS, "base_failed", "histograms"],
            )

    schema = ", ".join([*(f"{o} {types[k].simpleString()}" for o, k in zip(own, keep)), "lang string", *(f"{c} long" for c in COUNTS), "base_failed boolean", "histograms array<long>"])
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, keep)], *[F.col(c).alias(new[c]) for c in ("lang", *COUNTS, "base_failed", "histograms")]), new


def references(measures: DataFrame, names: dict[str, str]) -> dict[str, list[int]]:
    """The histograms' sums over the documents that pass the base rules, by language: at most five rows of
    27 numbers reach the driver."""
    passed = measures.where(~F.col(names["base_failed"])).select(F.col(names["lang"]).alias("lang"), F.col(names["histograms"]).alias("h"))
    sums = passed.groupBy("lang").agg(*[F.sum(F.col("h")[i]).alias(f"h{i}") for i in range(27)]).collect()
    return {x: [0] * 27 for x in [*COMMON, OTHER]} | {r["lang"]: list(r)[1:] for r in sums}


def judged(measures: DataFrame, names: dict[str, str], refs: dict[str, list[int]]) -> tuple[Column, Column, Column]:
    """(class_distance, word_distance, kept)."""
    h, lang, n = F.col(names["histograms"]), F.col(names["lang"]), F.col(names["n_words"])
    by_class = by_word = F.lit(0.0)
    for x, ref in refs.items():
        by_class = F.when(lang == x, js_distance(F.slice(h, 1, 6), ref[:6])).otherwise(by_class)
        by_word = F.when(lang == x, js_distance(F.slice(h, 7, 21), ref[6:])).otherwise(by_word)
    return by_class, by_word, ~F.col(names["base_failed"]) & (by_class < noise(6, n) + CLASS_MARGIN) & (by_word < noise(21, n) + WORD_MARGIN)


def quality_rules(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each document, then n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, class_distance, word_distance and kept. base_failed: n_words < 10, or
    100 * n_repeat_words > 20 * n_words. Texts are read once: counts and histograms are stored."""
    measures, names = measured(docs.select(*dict.fromkeys([*keep, "text", *(["lang"] if "lang" in docs.columns else [])])), keep)
    measures = stored(measures, "quality")
    by_class, by_word, kept = judged(measures, names, references(measures, names))
    counts = [F.col(names[c]).alias(c) for c in (*COUNTS, "base_failed")]
    return measures.select(*[F.col(f"`{c}`") for c in keep], *counts, by_class.alias("class_distance"), by_word.alias("word_distance"), kept.alias("kept"))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The documents that quality_rules keeps, with all their columns. Texts are read twice, so that they
    need not be stored or shuffled."""
    refs = references(*measured(docs, []))
    measures, names = measured(docs, docs.columns)
    return measures.where(judged(measures, names, refs)[2]).select(*[F.col(f"`{c}`") for c in docs.columns])
