"""Best-fit packing of token sequences by non-negative least squares over length patterns.

Documents are cut into pieces of at most ``most`` tokens. Only the histogram of piece lengths (at most
``most`` numbers) reaches the driver. There, lengths are grouped in ``grid`` bins; the patterns are all
multisets of one to three bins that fill a sequence; non-negative least squares fits how often each
pattern is used to the bins' counts; the repeat counts are rounded down. Pieces of the patterns'
bins, longest first, fill them (last the longest piece that fits), and what is left of the histogram is packed best-fit, longest first,
into the remaining gaps and new sequences. All of this works on runs of equal sequences, so the plan's
size depends on the number of lengths and not on that of documents. On the executors, pieces of one
length are numbered, and a piece's number says which run, sequence and offset it gets.

A null text is empty; a document without tokens still has its end-of-text id and so one piece.
Rows that repeat are packed each on their own.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import small, stored

MAX_LEN = 4096
END_ID = 1


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The x >= 0 of least |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(rounds):
        grad = atb - ata @ x
        grad[free] = -np.inf
        j = int(np.argmax(grad))
        if grad[j] <= tol:
            break
        free[j] = True
        while True:
            at = np.nonzero(free)[0]
            z = np.linalg.lstsq(ata[np.ix_(at, at)], atb[at], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            drop = at[x[at] <= 1e-12]
            if len(drop) == 0:
                drop = at[low][:1]
            x[drop] = 0
            free[drop] = False
    return x


def patterns(bins: int) -> list[tuple[int, ...]]:
    """Multisets of one to three of the bins 1..bins that sum to ``bins``, largest first."""
    out: list[tuple[int, ...]] = [(bins,)]
    out += [(bins - k, k) for k in range(1, bins // 2 + 1)]
    out += [(bins - j - k, j, k) for k in range(1, bins // 3 + 1) for j in range(k, (bins - k) // 2 + 1)]
    return out


@dataclass
class Run:
    """``n`` equal sequences: parts are (length, how many in each sequence), and a gap is left."""

    n: int
    gap: int
    parts: list[tuple[int, int]] = field(default_factory=list)


def fitted(counts: np.ndarray, most: int, grid: int) -> list[Run]:
    """Runs for the fitted patterns; takes their pieces out of ``counts`` (by length)."""
    width = -(-most // grid)
    grid = -(-most // width)
    per_bin = np.array([counts[i * width + 1 : (i + 1) * width + 1].sum() for i in range(grid)], float)
    pats = patterns(grid)
    a = np.zeros((grid, len(pats)))
    for j, p in enumerate(pats):
        for k in p:
            a[k - 1, j] += 1
    runs = []
    times = np.floor(nnls(a, per_bin) + 1e-6).astype(np.int64)
    for j in np.argsort(-times, kind="stable"):
        n, pat = int(times[j]), pats[j]
        for k in set(pat):
            n = min(n, int(counts[(k - 1) * width + 1 : k * width + 1].sum()) // pat.count(k))
        todo = [Run(n, most)] if n > 0 else []
        for i, k in enumerate(pat):  # a run splits where the pieces of a length are used up
            done: list[Run] = []
            for run in todo:
                # the longest pieces of the bin first; last, the longest that the gap takes
                length = run.gap if i == len(pat) - 1 else min(k * width, most)
                while run.n:
                    while counts[length] == 0:
                        length -= 1
                    m = int(min(run.n, counts[length]))
                    counts[length] -= m
                    done.append(Run(m, run.gap - length, [*run.parts, (length, 1)]))
                    run.n -= m
            todo = done
        runs += todo
    return runs


def packed(counts: np.ndarray, most: int = MAX_LEN, grid: int = 64) -> list[Run]:
    """All sequences, as runs, for the histogram ``counts`` (index: length, from 0 to most)."""
    counts = counts.astype(np.int64).copy()
    runs = fitted(counts, most, grid)
    by_gap: dict[int, list[Run]] = {}
    for r in runs:
        by_gap.setdefault(r.gap, []).append(r)
    has = np.zeros(most + 1, bool)
    has[list(by_gap)] = True
    for length in range(most, 0, -1):
        n = int(counts[length])
        while n:
            fit = length + int(np.argmax(has[length:])) if has[length:].any() else 0
            if fit:  # the smallest gap that takes it: each of these sequences takes as many as fit
                run, each = by_gap[fit].pop(), fit // length
                if not by_gap[fit]:
                    has[fit] = False
            else:
                each = most // length
                run = Run(-(-n // each), most)
            whole = min(run.n, n // each)
            odd = n - whole * each if whole < run.n else 0
            new = [Run(whole, run.gap - each * length, [*run.parts, (length, each)])] if whole else []
            if odd:
                new.append(Run(1, run.gap - odd * length, [*run.parts, (length, odd)]))
            rest = run.n - whole - bool(odd)
            if rest:
                new.append(Run(rest, run.gap, run.parts))
            for r in new:
                by_gap.setdefault(r.gap, []).append(r)
                has[r.gap] = True
            n -= whole * each + odd
    return [r for gap in sorted(by_gap) for r in by_gap[gap]]


@dataclass
class Plan:
    """Where the pieces of each length go: entry e holds the pieces of ``length[e]`` numbered from
    ``start[e]``; ``each[e]`` go in a sequence, from ``sequence[e]`` on, at ``offset[e]``."""

    length: np.ndarray
    start: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(runs: list[Run]) -> "Plan":
        rows, first = [], 0
        for r in runs:
            at = 0
            for length, each in r.parts:
                rows.append((length, each * r.n, each, first, at))
                at += length * each
            first += r.n
        t = np.array(rows or np.empty((0, 5)), np.int64)
        t = t[np.argsort(t[:, 0], kind="stable")]
        before = np.cumsum(t[:, 1]) - t[:, 1]
        begin = np.searchsorted(t[:, 0], t[:, 0])
        return Plan(t[:, 0], before - before[begin] if len(t) else before, t[:, 2], t[:, 3], t[:, 4])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.length, self.start, self.each, self.sequence, self.offset

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.float64) * 2.0**40  # lengths are below 2**13, numbers below 2**40
        e = np.searchsorted(key.astype(np.int64) + self.start, (length << 40) + number, side="right") - 1
        k = number - self.start[e]
        return self.sequence[e] + k // self.each[e], self.offset[e] + k % self.each[e] * length


class WordTokenizer:
    """Ids of texts as the tokenizer gives them (no special tokens added), as bytes of little-endian
    32-bit numbers. Texts of Latin letters and common marks are split here into the pre-tokens that
    the tokenizer's rules make, whose ids are kept; other texts go through the tokenizer whole, and so do
    all texts if the file has other rules than those below."""

    # The tokenizer's own rules, and its splitting pattern.
    RULES = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": ["Split", "ByteLevel"],
        "end_of_word_suffix": "</w>",
    }
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # Latin letters and common marks in which white space is that of str.split, lower case is a matter of
    # single letters, and nothing composes.
    PLAIN = re.compile("[\t-\r -~\xa1-\xac\xae-\u012f\u0131-\u024f\u2013\u2014\u2018-\u201d\u2022\u2026\u20ac]*")

    def __init__(self, file: bytes, most: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_buffer(file)
        self.by_words = self.splits_so(json.loads(file))
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.split = regex.compile(self.SPLIT).findall
        self.most = most
        self.words: dict[str, bytes] = {}  # what stands between white space
        self.parts: dict[str, bytes] = {}  # pre-tokens

    @classmethod
    def splits_so(cls, file: dict) -> bool:
        """Whether the tokenizer in the file normalises and splits as this class does."""
        steps = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            file.get("normalizer") == cls.RULES["normalizer"]
            and [s["type"] for s in steps] == cls.RULES["pre_tokenizer"]
            and steps[0].get("pattern") == {"Regex": cls.SPLIT}
            and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert") is True
            and not steps[1].get("use_regex")
            and file["model"].get("end_of_word_suffix") == cls.RULES["end_of_word_suffix"]
            and not any(t["content"] for t in file.get("added_tokens", []) if "<|" not in t["content"])
        )

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretokens(self, parts: list[str]) -> list[bytes]:
        """The ids of each pre-token. Many are encoded as one text, between blanks, which is much cheaper
        than one by one; each ends with its only end-of-word id."""
        out: list[bytes] = []
        for i in range(0, len(parts), 500):
            some = parts[i : i + 500]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.nonzero(self.ends[ids])[0] + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                out += self._encoded(some)
                continue
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[a:b] for a, b in zip(at, at[1:])]
        return out

    def _learn(self, new: list[str]) -> None:
        """Adds words, their unknown pre-tokens in one batch."""
        cut = [self.split(w) for w in new]
        ask = list({p for c in cut for p in c}.difference(self.parts))
        self.parts.update(zip(ask, self._pretokens(ask)))
        self.words.update((w, b"".join([self.parts[p] for p in c])) for w, c in zip(new, cut))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        out: list[bytes] = []
        for text in texts:
            if not self.by_words or "<|" in text or not self.PLAIN.fullmatch(text):
                out += self._encoded([text])
                continue
            words = text.lower().split()
            new = set(words).difference(self.words)
            if new:
                if len(self.words) + len(self.parts) > self.most:
                    self.words.clear()
                    self.parts.clear()
                    new = set(words)
                self._learn(list(new))
            out.append(b"".join(map(self.words.__getitem__, words)))
        return out


def tokenizer_here(file: bytes) -> WordTokenizer:
    """This process's tokenizer: tasks that follow in a worker find what earlier ones learnt."""
    held = sys.modules.setdefault("_meterloom_tokenizers", types.ModuleType("_meterloom_tokenizers")).__dict__
    key = f"t{zlib.crc32(file)}_{len(file)}"
    if key not in held:
        held[key] = WordTokenizer(file)
    return held[key]


def pieces_of(docs: DataFrame, file: bytes, most: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(file)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = None, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            tok = tok or tokenizer_here(shared.value)
            ids, text = batch.column(0), batch.column(1)
            doc, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                data, d = tok.ids([text[i].as_py() or ""])[0] + end, ids[i].as_py()
                for k, at in enumerate(range(0, len(data), 4 * most)):
                    part = data[at : at + 4 * most]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


#: Pieces of one length are numbered in groups of about so many.
GROUP_ROWS = 100_000


def numbered(pieces: DataFrame, counts: np.ndarray) -> DataFrame:
    """Adds number: pieces of a length are counted from 0. Each length is dealt into groups by its rows'
    numbers, numbered apart and shifted by the groups before, so a length that many have is no hot key, nor are
    repeated rows. There are as many groups as lengths, and one more for each GROUP_ROWS pieces."""
    spark = pieces.sparkSession
    groups = spark.createDataFrame([(int(k), int(counts[k] // GROUP_ROWS + 1)) for k in np.nonzero(counts)[0]], "length long, groups long")
    keyed = pieces.join(F.broadcast(groups), "length")  # a row for each length
    keyed = keyed.withColumn("grp", F.pmod(F.xxhash64("row"), F.col("groups"))).drop("groups")
    sizes = stored(keyed.groupBy("length", "grp").agg(F.count("*").alias("n")), "pack-sizes")
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    own = F.row_number().over(Window.partitionBy("length", "grp").orderBy("row"))
    before = small(stored(before.select("length", "grp", "before"), "pack-groups"))
    return keyed.withColumn("own", own).join(before, ["length", "grp"]).withColumn("number", F.col("before") + F.col("own") - 1).drop("own", "before", "grp")


def pack(docs: DataFrame, tokenizer_path: str, most: int = MAX_LEN, grid: int = 64) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of all rows."""
    with open(tokenizer_path, "rb") as f:
        file = f.read()
    # a row's number, once stored, stays
    cut = stored(pieces_of(docs, file, most).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(most + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``most`` rows
        counts[r["length"]] = r["n"]
    # plain arrays: broadcasts are pickled by reference to classes, which workers may lack
    plan = docs.sparkSession.sparkContext.broadcast(Plan.of(packed(counts, most, grid)).arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off = Plan(*plan.value).place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return numbered(cut, counts).select(*names, "number").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
