"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves. Each half has a codebook (k-means of a sample of at most ``SAMPLE`` rows, the
least by hash; every row is indexed), and a pair of codes is a cell. All that a searcher must know of the
index is small: two codebooks, the radius of each code (the largest distance of a row's half from its
code, over all rows) and the number of rows of each cell, at most ``CODES`` squared. For an anchor, the product with a
code plus the anchor's norm times the radius bounds the product with any row's half; the sum of two such bounds
bounds the score of any row of the cell. A heap visits cells by falling bound (multi-sequence), so an anchor
is certain of all cells from a point on where the bound falls below what it still needs.

Two searches use it, each in two passes: a pass over an anchor's first cells, until they hold ``PROBE`` rows, gives it a
score that it needs at least; a second pass visits all other cells whose bound reaches that score. The
first search finds the positives, the second, for each positive's window of scores, the best rows
of other labels. Results are exact: no cell that could change them is left out.

Rows are shuffled by cell, in blocks of at most ``BLOCK`` rows and ``QUERIES`` anchors, so a cell that a third of
all rows (copies of a vector, say) are in is many tasks; a task returns its best few for each anchor and window,
never pairs. Scores are sums of whole numbers below 2**53 in double precision, and so exact.

Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors meet those of
their own length only, and empty vectors nobody. Scores must stay below 2**53. A null vec_id is no anchor, comes last among ties, and keeps its
label. Rows that repeat are rows of their own: each is an anchor, and a positive of the other. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored

#: Rows that the codebooks are fitted on, at most, and codes of a half, at most.
SAMPLE, CODES = 16_384, 64
#: Rows of a cell and anchors that meet in one task, at most, and rows of an anchor's first cells.
BLOCK, QUERIES, PROBE = 8192, 4096, 512
LAST = (1 << 63) - 1  # stands for a null vec_id


def quantised(vectors: DataFrame, levels: int = 256, moved: int = 7, labels: int = 10) -> DataFrame:
    """row, vec_id, label and x (whole numbers) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = vectors.where(ok & label.isNotNull()).select(
        vec_id.alias("vec_id"),
        F.when(vec_id % moved == 0, (label + 1) % labels).otherwise(label).alias("label"),
        F.transform(v, lambda x: F.floor(x * levels).cast("double")).alias("x"),
    )
    # any distinct numbers will do, and once stored they stay
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "quantised")


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.argmin((codes * codes).sum(1) - 2 * (x @ codes.T), axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` codes; the first are spread over the rows' order along their main axis."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    main = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0] if x.shape[1] else np.zeros(0)
    codes = x[np.argsort(x @ main, kind="stable")[np.linspace(0, len(x) - 1, k).astype(int)]]
    for _ in range(rounds):
        own = nearest(x, codes)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(codes)
        np.add.at(sums, own, x)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
    return codes


class MultiIndex:
    """What a searcher knows: codebooks and radii of both halves, and the rows of each cell."""

    def __init__(self, codes: list[np.ndarray], radii: list[np.ndarray], sizes: np.ndarray):
        self.codes, self.radii, self.sizes = codes, radii, sizes
        self.cut = codes[0].shape[1]

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """For each half: the most that the product of each anchor with a row of each code can be."""
        out = []
        for half, codes, radii in zip((q[:, : self.cut], q[:, self.cut :]), self.codes, self.radii):
            out.append(half @ codes.T + np.sqrt((half * half).sum(1))[:, None] * radii)
        return out

    def cells(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) of each cell with rows, by falling bound: a heap holds the next cell of each code of
        the first half that has been reached."""
        a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        heap = [(-(one[a[0]] + two[b[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(b):
                heapq.heappush(heap, (-(one[a[i]] + two[b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(one[a[i + 1]] + two[b[0]]), i + 1, 0))
            cell = int(a[i]) * len(b) + int(b[j])
            if self.sizes[cell]:
                yield -bound, cell

    def visits(self, q: np.ndarray, least: np.ndarray, probe: int) -> Iterator[tuple[int, list[int]]]:
        """(anchor, its cells): the first ones until they hold ``probe`` rows, or, where ``probe`` is negative, those after
        them whose bound reaches ``least``."""
        one, two = self.bounds(q)
        slack = 0.5 + 1e-9 * (np.abs(one).max(initial=0) + np.abs(two).max(initial=0))  # scores are whole numbers
        for k in range(len(q)):
            seen, out = 0, []
            for bound, cell in self.cells(one[k], two[k]):
                first = seen < abs(probe)
                seen += int(self.sizes[cell])
                if probe > 0:
                    if not first:
                        break
                    out.append(cell)
                elif not first:
                    if bound + slack < least[k]:
                        break
                    out.append(cell)
            yield k, out


def fitted(rows: DataFrame, dims: int) -> tuple[MultiIndex, DataFrame]:
    """The index of the rows (all of ``dims`` components), and the rows with their cell."""
    n = rows.count()
    k = int(min(CODES, max(1, round((n / PROBE) ** 0.5))))
    sample = rows.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).select("x").toPandas()["x"]
    x, cut = np.array(sample.tolist()).reshape(len(sample), dims), (dims + 1) // 2
    codes = [k_means(x[:, :cut], k), k_means(x[:, cut:], k)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, own, far = _matrix(b.column("x")), [], []
                for half, c in zip((x[:, :cut], x[:, cut:]), codes):
                    at = nearest(half, c)
                    own.append(at)
                    far.append(np.sqrt(((half - c[at]) ** 2).sum(1)))
                cell = own[0].astype(np.int64) * len(codes[1]) + own[1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), *map(pa.array, far)], names=[*b.schema.names, "cell", "far0", "far1"])

    placed = stored(rows.mapInArrow(place, "vec_id long, label long, x array<double>, row long, cell long, far0 double, far1 double"), "cells")
    sizes = np.zeros(len(codes[0]) * len(codes[1]), np.int64)
    radii = [np.zeros(len(c)) for c in codes]
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far0").alias("far0"), F.max("far1").alias("far1")).collect():  # a row a cell
        sizes[r["cell"]] = r["n"]
        for half, code in enumerate(divmod(r["cell"], len(codes[1]))):
            radii[half][code] = max(radii[half][code], r[f"far{half}"])
    return MultiIndex(codes, radii, sizes), placed.drop("far0", "far1")


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) indices of each anchor's ``k`` highest allowed scores; of equal scores, the first rows."""
    n = score.shape[1]
    key = np.where(allowed, score, -np.inf)
    if n > k:
        # all that reach the k-th highest score, then the first rows of them
        kth = np.partition(key, n - k, axis=1)[:, n - k]
        i, j = np.nonzero((key > kth[:, None]) & allowed)
        ti, tj = np.nonzero((key == kth[:, None]) & allowed)  # by anchor, then row
        room = k - np.bincount(i, minlength=len(key))
        nth = np.arange(len(ti)) - np.searchsorted(ti, ti)
        ok = nth < room[ti]
        return np.concatenate([i, ti[ok]]), np.concatenate([j, tj[ok]])
    return np.nonzero(allowed)


def search(rows: DataFrame, index: MultiIndex, anchors: DataFrame, probe: int, k: int, windows: bool) -> DataFrame:
    """(anchor, window, vec_id, row, score): for each anchor the ``k`` best rows of each task that its cells fall to.

    ``anchors`` has anchor (a row number), label, x, least, and spans: null, or (low, high) scores of each window. Without
    windows, rows of the anchor's own label that reach ``least`` are looked for, else those of other labels whose score lies in a window."""
    model = anchors.sparkSession.sparkContext.broadcast((index.codes, index.radii, index.sizes))  # at most CODES squared numbers

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multi = MultiIndex(*model.value)
        for b in batches:
            if b.num_rows:
                for at, cells in multi.visits(_matrix(b.column("x")), b.column("least").to_numpy(), probe):
                    if cells:
                        yield pa.RecordBatch.from_arrays([pa.array([b.column("anchor")[at].as_py()]), pa.array([cells], pa.list_(pa.int64()))], names=["anchor", "cells"])

    reached = anchors.mapInArrow(reach, "anchor long, cells array<long>").select("anchor", F.explode("cells").alias("cell"))
    visits = stored(reached, "visits")
    spark = rows.sparkSession
    parts = {r["cell"]: -(-r["n"] // QUERIES) for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    table = [(c, -(-int(index.sizes[c]) // BLOCK), p) for c, p in parts.items()]
    shape = F.broadcast(spark.createDataFrame(table, "cell long, blocks long, parts long"))  # a row a cell
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = rows.join(shape, "cell").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).select("cell", "block", "vec_id", "row", "label", "x", each(F.col("parts")).alias("part"))
    right = visits.join(shape, "cell").withColumn("part", F.pmod(F.xxhash64("anchor"), F.col("parts"))).select("cell", "part", "anchor", each(F.col("blocks")).alias("block"))
    right = right.join(anchors.select("anchor", F.col("label").alias("own"), F.col("x").alias("q"), "spans", "least"), "anchor")
    names = ["anchor", "window", "vec_id", "row", "score"]

    def work(r: pa.Table, a: pa.Table) -> pa.Table:
        if not r.num_rows or not a.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        ids = r.column("vec_id").fill_null(LAST).to_numpy()
        number = r.column("row").to_numpy()
        order = np.lexsort((number, ids))
        ids, number, label = ids[order], number[order], r.column("label").to_numpy()[order]
        x, q = _matrix(r.column("x"))[order], _matrix(a.column("q"))
        anchor, own = a.column("anchor").to_numpy(), a.column("own").to_numpy()
        spans = a.column("spans").to_pylist() if windows else None
        least = a.column("least").to_numpy()
        found = []
        step = max(1, (4 << 20) // len(x))
        for at in range(0, len(q), step):
            some = slice(at, at + step)
            score = q[some] @ x.T
            same = own[some][:, None] == label
            if spans is None:
                i, j = best(score, same & (anchor[some][:, None] != number) & (score >= least[some][:, None]), k)
                found.append((anchor[some][i], np.zeros(len(i), np.int64), ids[j], number[j], score[i, j]))
                continue
            for w in range(max(map(len, spans[some]))):
                low, high = (np.array([s[w][side] if w < len(s) else edge for s in spans[some]], float) for side, edge in (("low", np.inf), ("high", -np.inf)))
                i, j = best(score, ~same & (score >= low[:, None]) & (score <= high[:, None]), k)
                found.append((anchor[some][i], np.full(len(i), w), ids[j], number[j], score[i, j]))
        return pa.table({c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in zip(names, zip(*found))})

    return left.groupBy("cell", "block", "part").cogroup(right.groupBy("cell", "block", "part")).applyInArrow(work, ", ".join(f"{c} long" for c in names))


def first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and window, numbered from 1 in ``rank``."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(rows: DataFrame, index: MultiIndex, anchors: DataFrame, k: int, windows: bool, tag: str) -> DataFrame:
    """The first ``k`` of each anchor and window over all rows."""
    never = F.lit(float("-inf"))
    probed = stored(search(rows, index, anchors.withColumn("least", never), PROBE, k, windows), f"{tag}-probe")
    kth = first(probed, k).where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    rest = anchors.join(kth, "anchor", "left")
    # what is below an anchor's k-th best so far can't be among its best: neither cells nor rows
    if windows:
        rest = rest.withColumn("spans", F.transform("spans", lambda s, w: F.struct(F.coalesce(F.col("kth")[w.cast("long")], s["low"]).alias("low"), s["high"].alias("high"))))
        lows = F.transform("spans", lambda s: F.when(s["low"] <= s["high"], s["low"].cast("double")))
        rest = rest.withColumn("least", F.coalesce(F.array_min(lows), F.lit(float("inf"))))
    else:
        rest = rest.withColumn("least", F.coalesce(F.col("kth")[F.lit(0).cast("long")].cast("double"), never))
    rest = stored(rest.drop("kth"), f"{tag}-anchors")
    more = stored(search(rows, index, rest, -PROBE, k, windows), f"{tag}-rest")
    out = stored(first(probed.unionByName(more), k), f"{tag}-found")
    released(probed, rest, more)
    return out


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, **how: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor (vec_id
    divisible by ``every``) and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` hundredths of the positive's. ``how`` goes to ``quantised``."""
    rows = quantised(vectors, **how)
    out = None
    for r in rows.groupBy(F.size("x").alias("n")).count().orderBy("n").collect():
        got = _of_length(rows.where(F.size("x") == r["n"]), r["n"], positives, negatives, low, high, every)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _of_length(rows: DataFrame, dims: int, positives: int, negatives: int, low: int, high: int, every: int) -> DataFrame:
    index, placed = fitted(rows, dims)
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), "vec_id", "label", "x")
    span = "array<struct<low:long,high:long>>"
    bare = anchors.drop("vec_id").withColumn("spans", F.lit(None).cast(span))
    near = exact(placed, index, bare, positives, False, "positives")
    # 100 * score >= low * positive and 100 * score <= high * positive, in whole numbers
    scores = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("score").alias("s")))).alias("near"))
    window = F.transform("near", lambda p: F.struct((-F.floor(-p["s"] * low / F.lit(100))).cast("long").alias("low"), F.floor(p["s"] * high / F.lit(100)).cast("long").alias("high")))
    spans = stored(anchors.join(scores, "anchor").select("anchor", "label", "x", window.cast(span).alias("spans")), "windows")
    far = exact(placed, index, spans, negatives, True, "negatives")
    near = near.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive"), F.col("score").alias("positive_score"))
    far = far.select("anchor", "window", "rank", F.col("vec_id").alias("negative"), F.col("score").alias("negative_score"))
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return (
        far.join(near, ["anchor", "window"])
        .join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", known("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative").alias("negative_id"), "positive_score", "negative_score")
    )
