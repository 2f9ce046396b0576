"""Ranked lexical search over a K2-treap of the term-document grid.

Documents are read once: each becomes its number of terms and, for terms that some item asks for, the term's
number and frequency. Totals over all documents (documents, terms, documents of a term) give the weights.
Then each task cuts its documents into ranges of at most ``RANGE`` documents and ``POSTINGS`` entries. A range
is a grid of terms and documents, kept as a compressed quadtree: level by level, a cell that has entries has a mask of
its four children and the number of its first child, and holds the maximum impact in it. (An impact is the part of a
score that depends on a document alone; a term's weight multiplies it.)

An item's terms are rows of the grid. A document range of the tree has, for each row, the cell that the row and
the range meet in; the weighted sum of these cells' maxima bounds the score of every document of the range. Ranges are
halved best first, all rows at once, until no range's bound reaches the item's tenth score; ranges of one document have
their score as bound. What an item has found in one range is its threshold in the next ones of the task.
Tasks return ten documents an item at most, and only these are shuffled.

Items are taken in groups of about ``ITEM_TERMS`` terms: a group's terms are what is sent to tasks, and
each group reads the documents once (registered items are one group).

A null text has no terms. Documents and items without terms match nothing, a document that repeats is listed
as often as it is there, an item that repeats gets its documents each time. Equal scores are
ordered by doc_id, null last. Very long texts are read whole; other columns are ignored; empty tables give no rows.
Scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored

#: Documents of a range and their entries, at most; and item terms that are searched for together.
RANGE, POSTINGS, ITEM_TERMS = 1 << 14, 1 << 22, 1 << 20
#: Document ranges that are halved at a time.
WIDTH = 64
LAST = (1 << 63) - 1  # stands for a null doc_id

#: UTF-8 bytes: ASCII letters and digits and all bytes beyond ASCII belong to terms, A-Z in lower case.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The scores' document part; ``n``: terms of each entry's document."""
    m = 100 - 90 + 90 * n * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**32, each moved to twice its place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """A compressed quadtree of (row, column, impact) entries, each place at most once, with maxima of impacts."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.height = int(max(row.max(initial=0), column.max(initial=0), 1)).bit_length()
        place = _spread(row) << np.uint64(1) | _spread(column)  # z-order: each pair of bits is a child's number
        order = np.argsort(place, kind="stable")
        place, best = place[order], value[order]
        self.best, self.mask, self.first = [best], [], []
        for _ in range(self.height):
            up = place >> np.uint64(2)
            begin = np.nonzero(np.diff(up, prepend=up[:1] + np.uint64(1)))[0]
            child = np.left_shift(1, (place & np.uint64(3)).astype(np.uint8), dtype=np.uint8)
            self.mask.append(np.bitwise_or.reduceat(child, begin) if len(begin) else child)
            self.first.append(begin)
            best = np.maximum.reduceat(best, begin) if len(begin) else best
            self.best.append(best)
            place = up[begin]
        for levels in (self.best, self.mask, self.first):
            levels.reverse()  # from the root on

    #: Of a mask: how many children come before each child; -1 where it has not got the child.
    BEFORE = np.array([[(m & ((1 << q) - 1)).bit_count() if m >> q & 1 else -1 for q in range(4)] for m in range(16)])

    def root(self, rows: np.ndarray) -> np.ndarray:
        """The rows' cells in the range of all columns; -1 where there is none."""
        return np.where((rows >> self.height == 0) & (len(self.best[-1]) > 0), 0, -1)

    def halves(self, level: int, cells: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (ranges x rows) of a level to those of the ranges' left and right halves."""
        child = (rows >> (self.height - 1 - level) & 1) << 1
        mask = np.where(cells >= 0, self.mask[level][cells], 0)
        first = self.first[level][cells]
        return tuple(np.where((b := self.BEFORE[mask, child | side]) >= 0, first + b, -1) for side in (0, 1))

    def bound(self, level: int, cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.where(cells >= 0, self.best[level][cells], 0) @ weights


def descend(treap: Treap, rows: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, columns) of columns with a score above 0 and not below ``least``, the ``k`` best among them."""
    empty = np.empty(0, np.int64)
    pools: list[tuple] = [(empty, empty, np.empty((0, len(rows)), np.int64)) for _ in range(treap.height)]

    def push(level: int, start: np.ndarray, cells: np.ndarray) -> None:
        nonlocal scores, columns, least
        bound = treap.bound(level, cells, weights)
        ok = bound >= max(least, 1)
        if level == treap.height:
            scores, columns = np.concatenate([scores, bound[ok]]), np.concatenate([columns, start[ok]])
            order = np.lexsort((columns, -scores))[:k]
            scores, columns = scores[order], columns[order]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
        elif ok.any():
            pools[level] = tuple(np.concatenate(p) for p in zip(pools[level], (bound[ok], start[ok], cells[ok])))

    scores, columns = empty, empty
    push(0, np.zeros(1, np.int64), treap.root(rows)[None, :])
    while True:
        tops = [int(p[0].max(initial=-1)) for p in pools]
        level = max(range(treap.height), key=lambda i: (tops[i], i))
        if tops[level] < max(least, 1):
            return scores, columns
        bound, start, cells = pools[level]
        order = np.argsort(-bound, kind="stable")
        some, rest = order[:WIDTH], order[WIDTH:]
        rest = rest[bound[rest] >= least]
        pools[level] = (bound[rest], start[rest], cells[rest])
        left, right = treap.halves(level, cells[some], rows)
        half = 1 << (treap.height - 1 - level)
        push(level + 1, np.concatenate([start[some], start[some] + half]), np.concatenate([left, right]))


def read(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n and the asked terms' numbers and frequencies of each document with a term."""
    asked = docs.sparkSession.sparkContext.broadcast(numbers)  # terms of one group of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = asked.value.get
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                words = terms_of(text[i].as_py() or b"")
                if words:
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    for column, v in zip(out, (ids[i].as_py(), len(words), list(found), list(found.values()))):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def item_terms(items: DataFrame) -> DataFrame:
    """item, item_id and terms (as bytes) of each item with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(dict.fromkeys(terms_of(t or b""))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))], names=["item", "item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", "text")
    return stored(rows.mapInArrow(run, "item long, item_id long, terms array<binary>").where("size(terms) > 0"), "items")


def searched(index: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each item, the ``k`` best documents of each task."""
    sent = index.sparkSession.sparkContext.broadcast((items, weights))  # one group of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight_of = sent.value
        found = {i: (np.empty(0, np.int64), np.empty(0, np.int64)) for i, _ in asked}  # scores, doc_ids

        def search(ids: list, n: list, entries: list, tf: list) -> None:
            ids_, length, count = np.concatenate(ids), np.concatenate(n), np.concatenate([np.diff(o) for o, _ in entries])
            order = np.argsort(ids_, kind="stable")  # so that columns are in the order of ties
            column = np.empty(len(order), np.int64)
            column[order] = np.arange(len(order))
            row = np.concatenate([v for _, v in entries]).astype(np.int64)
            value = impact(np.concatenate(tf).astype(np.int64), np.repeat(length, count), documents, terms)
            # rows of this range: the terms that it has
            own, at = np.unique(row, return_inverse=True)
            treap, by_column = Treap(at, np.repeat(column, count), value), ids_[order]
            for item, ask in asked:
                place = np.searchsorted(own, ask)
                ok = place < len(own)
                ok[ok] = own[place[ok]] == ask[ok]
                if not ok.any():
                    continue
                scores, docs = found[item]
                new, columns = descend(treap, place[ok], weight_of[ask[ok]], k, int(scores[-1]) if len(scores) == k else 1)
                scores, docs = np.concatenate([scores, new]), np.concatenate([docs, by_column[columns]])
                best = np.lexsort((docs, -scores))[:k]
                found[item] = scores[best], docs[best]

        held: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = sum(len(x) for x in held[0])
                many = sum(len(v) for _, v in held[2])
                some = batch.slice(at, RANGE - size)
                ends = np.cumsum(np.diff(some.column("terms").offsets.to_numpy()))
                some = some.slice(0, max(int(np.searchsorted(ends, POSTINGS - many, "right")), 0 if size else 1))
                if some.num_rows:
                    at += some.num_rows
                    for part, v in zip(held, (some.column("doc_id").fill_null(LAST).to_numpy(), some.column("n").to_numpy(), (some.column("terms").offsets.to_numpy(), some.column("terms").flatten().to_numpy()), some.column("tf").flatten().to_numpy())):
                        part.append(v)
                if at < batch.num_rows:  # the range is full
                    search(*held)
                    held = ([], [], [], [])
        if held[0]:
            search(*held)
        rows = [(item, d if d != LAST else None, s) for item, (scores, docs) in found.items() for s, d in zip(scores.tolist(), docs.tolist())]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 10_000])], names=["item", "doc_id", "score"])

    return index.select("doc_id", "n", "terms", "tf").mapInArrow(run, "item long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` highest-scoring documents."""
    asked = item_terms(items)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = max(1, -(-total // ITEM_TERMS))
    out = None
    for g in range(groups):
        got = _of_group(docs, asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g), k)
        out = got if out is None else out.unionByName(got)
    return out


def _of_group(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = asked.collect()  # about ITEM_TERMS terms
    numbers: dict[bytes, int] = {}
    items = [(r["item"], np.sort([numbers.setdefault(bytes(t), len(numbers)) for t in r["terms"]])) for r in rows]
    index = stored(read(docs, numbers), "term-counts")
    totals = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(numbers), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row a term of the group
        df[r["t"]] = r["df"]
    weights = np.array([weight(totals["documents"], int(x)) for x in df], np.int64)
    best = stored(searched(index, items, weights, totals["documents"], max(totals["terms"], 1), k), "item-documents")
    released(index)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
