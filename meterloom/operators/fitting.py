"""Detectors fitted on DataFrames: the driver sees models, counts and sums, never training rows.

* Isolation forests: rows are drawn by hash. A pool of the rows (four times what all trees draw together, or all rows) is
  dealt to the trees that take them; each tree is grown in a task of its own from the rows it drew.
* One-class machines: the sample that they take anyway (5000 rows by default) is that of the least
  hashes, found as a top-k; one task solves for it and returns its support vectors.
* Networks: the examples are stored once; each pass over them sums losses and gradients in every partition, and
  partitions' sums are added up in rounds of groups until few are left. What is random in training hangs
  on an example's key, so partitioning doesn't matter.

Rows with a missing feature are no examples. Rows that repeat count as often as they are there. Without examples a
fit is an error. Executors that are lost cost the partitions of one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import released, stored
from .models import FEATURES, IsolationForest, Network, OneClassSVM, WindowModel, score, score_windows, windows_of

#: Rows of a forest's pool for each row that a tree draws.
POOL = 4
#: Sums of partitions that are added up by one task, or by the driver.
FAN = 32


def examples(df: DataFrame, cols: list[str], key: tuple[str, ...] = ("entity", "idx")) -> DataFrame:
    """(key, x): complete rows, x of shape (features,), with a number from the row's key."""
    x = F.array(*[F.col(c).cast("double") for c in cols])
    return _complete(df.select(F.xxhash64(*key).alias("key"), x.alias("x")))


def window_examples(windows: DataFrame) -> DataFrame:
    """(key, length, x): complete windows, their rows one after another."""
    return _complete(windows.select(F.xxhash64("entity", "start").alias("key"), F.size("values").alias("length"), F.flatten("values").alias("x")))


def _complete(df: DataFrame) -> DataFrame:
    return df.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _draw(tree: Column, seed: int) -> Column:
    """Where a row stands in a tree's order, from 0 to 1."""
    return F.xxhash64(F.lit("tree"), F.lit(seed), tree, F.col("key")).cast("double") / 2.0**64 + 0.5


def drawn(rows: DataFrame, forest: IsolationForest, n: int) -> tuple[DataFrame, int]:
    """(tree, place, key, x) of the rows that trees may draw, and how many each takes: those of the least places."""
    m = forest.rows_a_tree(n)
    pool = min(n, POOL * m * forest.trees)
    # six deviations more than needed, so that no tree is short of rows
    enough = lambda share, of: min(1.0, (share * of + 6 * (share * of) ** 0.5 + 20) / of)
    some = rows if pool == n else rows.where(_draw(F.lit(-1), forest.seed) < enough(pool / n, n))
    trees = F.sequence(F.lit(0), F.lit(forest.trees - 1))
    level = enough(m / pool, pool)
    some = some.withColumn("tree", F.explode(F.filter(trees, lambda t: _draw(t, forest.seed) < level)))
    return some.select("tree", _draw(F.col("tree"), forest.seed).alias("place"), "key", "x"), m


def fit_forest(rows: DataFrame, forest: IsolationForest) -> IsolationForest:
    n = rows.count()
    if not n:
        raise ValueError("no complete rows to fit on")
    taken, m = drawn(rows, forest, n)

    def grow(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("key").to_numpy(), t.column("place").to_numpy()))[:m]
        parts = forest.tree(_matrix(t.column("x"))[order], m, key[0].as_py())
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32())} | {c: pa.array([np.asarray(v, float)], pa.list_(pa.float64())) for c, v in zip(names, parts)})

    names = ("col", "cut", "left", "right", "size")
    grown = taken.groupBy("tree").applyInArrow(grow, "tree int, " + ", ".join(f"{c} array<double>" for c in names))
    forest_rows = sorted(grown.collect())  # models: at most twice as many nodes as a tree has rows
    trees = [tuple(np.asarray(r[c], float if c == "cut" else int) for c in names) for r in forest_rows]
    return forest.grown(m, trees)


def fit_machine(rows: DataFrame, machine: OneClassSVM) -> OneClassSVM:
    sample = rows.orderBy(F.xxhash64(F.lit("machine"), F.lit(machine.seed), F.col("key")), "key").limit(machine.most)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # at most ``most`` rows
        if held:
            t = pa.Table.from_batches(held)
            made = machine.fit(_matrix(t.column("x"))[np.argsort(t.column("key").to_numpy(), kind="stable")])
            yield pa.RecordBatch.from_arrays([pa.array(made.x.tolist(), pa.list_(pa.float64())), pa.array(made.a), pa.array([made.rho] * len(made.a)), pa.array([made.g] * len(made.a))], names=["x", "a", "rho", "g"])

    got = sample.coalesce(1).mapInArrow(solve, "x array<double>, a double, rho double, g double").collect()  # support vectors
    if not got:
        raise ValueError("no complete rows to fit on")
    machine.x, machine.a = np.array([r["x"] for r in got]), np.array([r["a"] for r in got])
    machine.rho, machine.g = got[0]["rho"], got[0]["g"]
    return machine


def tree_sum(parts: DataFrame, n: int, width: int) -> np.ndarray:
    """The sum of rows (part, v) of ``n`` parts, each at most once: groups of FAN are added up until FAN are left."""

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("part").to_numpy())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([_matrix(t.column("v"))[order].sum(0)], pa.list_(pa.float64()))})

    while n > FAN:
        n = -(-n // FAN)
        parts = parts.withColumn("group", F.pmod("part", F.lit(n))).groupBy("group").applyInArrow(add, "part int, v array<double>")
    out = np.zeros(width)
    for r in sorted(parts.collect(), key=lambda r: r["part"]):  # at most FAN rows
        out += np.asarray(r["v"])
    return out


def gradient_pass(rows: DataFrame, n_parts: int, model: Network, shape: tuple[int, ...], params: dict[str, np.ndarray], number: int, hold: bool) -> np.ndarray:
    """``model.sums`` over all rows (key, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                got = model.sums(params, _matrix(b.column("x")).reshape(b.num_rows, *shape), b.column("key").to_numpy(), number, hold)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["part", "v"])

    return tree_sum(rows.mapInArrow(run, "part int, v array<double>"), n_parts, 4 + sum(v.size for v in params.values()))


def fit_network(rows: DataFrame, model: Network, shape: tuple[int, ...]) -> Network:
    # small examples can cost much each, so all cores get some, however few bytes they are
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = stored(rows.select("key", "x").repartition(cores, "key"), "examples")
    n = rows.count()
    if not n:
        raise ValueError("no complete examples to fit on")
    n_parts = rows.rdd.getNumPartitions()
    model.trained(shape, lambda params, number: gradient_pass(rows, n_parts, model, shape, params, number, n > 10))
    released(rows)
    return model


def fit(train: DataFrame, detector, cols: list[str] = FEATURES, key: tuple[str, ...] = ("entity", "idx")):
    """Fits the detector on all complete rows of the training table."""
    rows = examples(train, cols, key)
    if isinstance(detector, IsolationForest):
        return fit_forest(rows, detector)
    if isinstance(detector, OneClassSVM):
        return fit_machine(rows, detector)
    return fit_network(rows, detector, (len(cols),))


def fit_windows(windows: DataFrame, model: WindowModel) -> WindowModel:
    """Fits on all complete windows (of one length)."""
    rows = window_examples(windows)
    one = rows.select("length", F.size("x").alias("n")).first()
    if one is None:
        raise ValueError("no complete examples to fit on")
    return fit_network(rows, model, (one["length"], one["n"] // one["length"]))


def tune(train: DataFrame, val: DataFrame, events: DataFrame, grid: list[Callable], cols: list[str] = FEATURES, window: int = 336, length: int = 14, stride: int = 7) -> tuple[int, list[float]]:
    """The index of the grid's detector with the best micro F1 on validation events (ties: the first), and
    all objectives. Networks over windows take windows of ``length`` every ``stride`` rows, the load first; validation
    rows that no such window holds have no score and no flag. Each configuration scores once; the stored scores are flagged and
    judged together, the configuration's number being part of the entity, and the events are stored before they are read."""
    from .evaluate import micro_f1
    from .windows import trailing_flags

    number = lambda i: F.struct(F.lit(i).alias("number"), "entity").alias("entity")
    events = stored(events, "events")
    scores = []
    for i, make in enumerate(grid):
        model = make()
        if isinstance(model, WindowModel):
            s = score_windows(windows_of(val, cols, length, stride), fit_windows(windows_of(train, cols, length, stride), model)).withColumnRenamed("x", "s")
            s = val.select("entity", "idx").join(s, ["entity", "idx"], "left")
        else:
            s = score(val, fit(train, model, cols), cols)
        # a null entity meets no event, also where it is part of a struct
        scores.append(stored(s.where("entity is not null").select(number(i), "idx", "s"), "scores"))
    flags = stored(trailing_flags(reduce(DataFrame.unionByName, scores), window=window).select("entity", "idx", "flag"), "flags")
    every = events.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))).withColumn("entity", number(F.col("__i"))).drop("__i")
    found = {r["number"]: r["micro_f1"] for r in micro_f1(flags, every, [F.col("entity.number").alias("number")]).collect()}  # a row a configuration
    released(events, flags, *scores)
    got = [float(found.get(i) or 0.0) for i in range(len(grid))]
    return max(range(len(got)), key=lambda i: (got[i], -i)), got
