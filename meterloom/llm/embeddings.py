"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2 t). Vectors are turned to their principal
axes (from the sums of their outer products, one small matrix a task); cells of width eps on the leading
axes, compared lexicographically, are the grid order. The ordered sequence is cut into intervals,
each with its bounding box. Two intervals whose boxes are more than eps apart hold no link and are
never joined; others are a unit: the two intervals are halved again and again, parts provably distant
skipped, until small parts are multiplied. Candidates are taken in single precision with a margin and
decided by the cosine in double precision. Units return counts and spanning edges, never pairs.

An interval is sent once to each interval that it must meet, so what is shuffled is rows times intervals:
intervals are as long as keeps all cores busy, up to 32 MB; vectors travel in the type that they came in.

Equal vectors are one class, joined once however many there are. Vectors that are null, empty, zero, or
hold null or non-finite components, link with nothing and are components of their own. Vectors link
with those of their own length only; each length is joined by itself. Rows with one vec_id are vectors like others; a null vec_id is
compared too, but is nobody's smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, released, small, stored

CHUNK, LEAF, LEADING = 1024, 256, 12
#: An interval has at least so many vectors, and at most so many bytes (of double precision).
LEAST, MOST_BYTES = 4096, 32 << 20
#: Interval boxes that share a cell are compared in groups of about so many.
GROUP = 256
MARGIN = 1e-4


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(lists: pa.Array) -> np.ndarray:
    """The vectors of a column of lists, none of them null, all of one length."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, v; classes: v, copies, vec_id, key) of the vectors that can link. Components keep
    single precision if that is their type, else they become double."""
    element = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{element}>")
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # -0.0 is 0.0
    v = F.when(ok, F.transform(v, lambda x: x + F.lit(0.0).cast(element)))
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")), "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    # any distinct numbers will do, and once stored they stay
    return rows, stored(classes.withColumn("key", F.monotonically_increasing_id()), "vector-classes")


def axes_of(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, principal axes by falling variance) of the unit vectors of all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column(0)))
                part = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    sums = classes.select("v").mapInArrow(run, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    s = np.array([r["s"] for r in sums])
    d = int(round((-1 + np.sqrt(4 * len(s) - 3)) / 2))  # len(s) = 1 + d + d*d
    mean = s[1 : d + 1] / s[0]
    return mean, np.linalg.eigh(s[d + 1 :].reshape(d, d) / s[0] - np.outer(mean, mean))[1][:, ::-1]


def interval_length(n: int, dims: int, cores: int) -> int:
    """Vectors of an interval: a few units for each core if there are enough vectors, 32 MB at most."""
    most = max(CHUNK, MOST_BYTES // (8 * dims))
    return max(CHUNK, min(most, max(LEAST, int(n / (2 * max(1, cores) ** 0.5)))) // CHUNK * CHUNK)


def ordered(classes: DataFrame, mean: np.ndarray, axes: np.ndarray, eps: float) -> DataFrame:
    """Chunks of the grid order: interval, chunk, keys, copies and vectors (as bytes), and the box of
    the chunk on the leading axes."""
    k = min(LEADING, axes.shape[1])
    kind = np.dtype(np.float32 if classes.schema["v"].dataType.simpleString() == "array<float>" else np.float64)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                c = np.floor((_unit(x) - mean) @ axes[:, :k] / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("copies"), pa.array(c.tolist(), pa.list_(pa.int32())), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], names=["key", "copies", "cell", "x"]
                )

    placed = stored(classes.select("key", "copies", "v").mapInArrow(cells, "key long, copies long, cell array<int>, x binary"), "cells")
    n = placed.count()
    length = interval_length(n, len(mean), classes.sparkSession.sparkContext.defaultParallelism)
    parts = max(1, -(-n // length))
    # the key breaks ties, so a cell that many are in is cut like any other stretch
    line = placed.repartitionByRange(parts, "cell", "key").sortWithinPartitions("cell", "key").withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = 0

        def chunk(rows):
            x = np.frombuffer(b"".join(r[2] for r in rows), kind).reshape(len(rows), -1)
            p = (_unit(x) - mean) @ axes[:, :k]
            return {
                "interval": rows[0][3] * 1_000_000 + number // (length // CHUNK),
                "chunk": number,
                "n": len(rows),
                "keys": np.array([r[0] for r in rows], np.int64).tobytes(),
                "copies": np.array([r[1] for r in rows], np.int64).tobytes(),
                "x": x.tobytes(),
                "lo": p.min(0).tolist(),
                "hi": p.max(0).tolist(),
            }

        schema = pa.schema([("interval", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("copies", pa.binary()), ("x", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
        for b in batches:
            held += zip(*(b.column(c).to_pylist() for c in ("key", "copies", "x", "part")))
            while len(held) >= CHUNK:
                yield pa.RecordBatch.from_pylist([chunk(held[:CHUNK])], schema=schema)
                held, number = held[CHUNK:], number + 1
        if held:
            yield pa.RecordBatch.from_pylist([chunk(held)], schema=schema)

    kept = line.select("key", "copies", "x", "part").mapInArrow(cut, "interval long, chunk long, n long, keys binary, copies binary, x binary, lo array<double>, hi array<double>")
    return stored(kept, "grid-order")


def interval_pairs(chunks: DataFrame, eps: float) -> DataFrame:
    """(i, j), i <= j: the intervals whose boxes are at most eps apart. Boxes are matched by the first
    axis' cells that they reach (an interval of the order has few), then compared on all axes. A cell's
    boxes are dealt into groups on one side, so a cell that most intervals reach is many keys."""
    box = chunks.select("interval", F.posexplode(F.arrays_zip("lo", "hi"))).groupBy("interval", "pos").agg(F.min("col.lo").alias("lo"), F.max("col.hi").alias("hi"))
    box = box.groupBy("interval").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("box"))
    box = stored(box, "boxes")
    groups = max(1, -(-box.count() // GROUP))
    first = lambda side: F.floor(F.element_at("box", 1)[side] / eps)
    left = box.select(F.col("interval").alias("i"), F.col("box").alias("bi"), F.pmod(F.xxhash64("interval"), F.lit(groups)).alias("grp"), F.explode(F.sequence(first("lo") - 1, first("hi") + 1)).alias("cell"))
    right = box.select(F.col("interval").alias("j"), F.col("box").alias("bj"), F.explode(F.sequence(first("lo"), first("hi"))).alias("cell"))
    right = right.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    apart = F.aggregate(
        F.zip_with("bi", "bj", lambda a, b: F.greatest(F.lit(0.0), a["lo"] - b["hi"], b["lo"] - a["hi"])), F.lit(0.0), lambda acc, x: acc + x * x
    )
    return left.join(right, ["cell", "grp"]).where((F.col("i") <= F.col("j")) & (apart <= eps * eps + 1e-9)).select("i", "j").distinct()


def _far(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float((gap * gap).sum()) > eps * eps + 1e-9


def joined(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, t: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= t, by recursive halving; of one sequence with itself, i < j only."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * t)))
    fx, fy = x.astype(np.float32), y.astype(np.float32)
    out_i, out_j = [], []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a or b <= a or d <= c:
            continue
        if _far(px[a:b], py[c:d], eps):
            continue
        if b - a > LEAF or d - c > LEAF:
            m, n = (a + b) // 2, (c + d) // 2
            xs = [(a, m), (m, b)] if b - a > LEAF else [(a, b)]
            ys = [(c, n), (n, d)] if d - c > LEAF else [(c, d)]
            todo += [(*p, *q) for p in xs for q in ys if not (same and q[1] <= p[0])]
            continue
        i, j = np.nonzero(fx[a:b] @ fy[c:d].T >= t - MARGIN)
        if len(i):
            i, j = i + a, j + c
            ok = (x[i] * y[j]).sum(1) >= t
            if same:
                ok &= i < j
            out_i.append(i[ok])
            out_j.append(j[ok])
    none = np.empty(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    lab = np.arange(n)
    while True:
        low = lab.copy()
        np.minimum.at(low, i, lab[j])
        np.minimum.at(low, j, lab[i])
        low = low[low]
        if (low == lab).all():
            return lab
        lab = low


def links(chunks: DataFrame, pairs: DataFrame, mean: np.ndarray, axes: np.ndarray, t: float) -> DataFrame:
    """(key, links, root) of vectors with links, for each unit."""
    lead = axes[:, : min(LEADING, axes.shape[1])]
    dims = len(mean)
    unit = F.xxhash64("i", "j").alias("unit")
    sides = pairs.select(unit, F.col("i").alias("interval"), F.when(F.col("i") == F.col("j"), 2).otherwise(0).alias("side"))
    sides = sides.unionByName(pairs.where("i < j").select(unit, F.col("j").alias("interval"), F.lit(1).alias("side")))
    rows = chunks.select("interval", "chunk", "keys", "copies", "x").join(small(stored(sides, "units")), "interval")

    def work(key, t_):
        r = sorted(zip(t_["side"].to_pylist(), t_["chunk"].to_pylist(), t_["keys"].to_pylist(), t_["copies"].to_pylist(), t_["x"].to_pylist()))
        part = []
        for side in ((0, 1) if r[0][0] < 2 else (2,)):
            own = [q for q in r if q[0] == side]
            ks, cs = (np.concatenate([np.frombuffer(q[c], np.int64) for q in own]) for c in (2, 3))
            raw = b"".join(q[4] for q in own)
            part.append((ks, cs, _unit(np.frombuffer(raw, np.float32 if len(raw) == 4 * dims * len(ks) else np.float64).reshape(len(ks), dims))))
        a, b = part[0], part[-1]
        same = len(part) == 1
        pa_, pb = (a[2] - mean) @ lead, (b[2] - mean) @ lead
        i, j = joined(a[2], b[2], pa_, pb, t, same)
        off = 0 if same else len(a[0])
        keys, copies = (a[0], a[1]) if same else (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
        j = j + off
        n = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
        has = n > 0
        root = _roots(i, j, len(keys))
        return pa.table({"key": keys[has], "links": n[has].astype(np.int64), "root": keys[root[has]]})

    return rows.groupBy("unit").applyInArrow(work, "key long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with cosine >= threshold), component_id
    (smallest vec_id reachable, itself included), kept (vec_id = component_id)."""
    rows, classes = classes_of(vectors)
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    found = None
    for r in classes.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():
        own = classes.where(F.size("v") == r["n"])
        mean, axes = axes_of(own)
        chunks = ordered(own, mean, axes, eps)
        got = stored(links(chunks, stored(interval_pairs(chunks, eps), "interval-pairs"), mean, axes, threshold), "vector-links")
        released(chunks)
        found = got if found is None else found.unionByName(got)
    info = classes.select("v", "key", "copies", "vec_id")
    if found is not None:
        comp = components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "key")
        info = info.join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(comp, "key", "left")
        info = stored(info.withColumn("component", F.coalesce("component", "key")), "vector-info")
        least = stored(info.groupBy("component").agg(F.min("vec_id").alias("component_id")), "vector-least")
        info = info.join(least, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    else:
        info = info.select("v", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.join(stored(info, "vector-result"), "v", "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
