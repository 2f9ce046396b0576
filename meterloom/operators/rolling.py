"""Rolling medians of series: an ordered window that takes and gives values in the time of a search.

A frame's median by Spark's own ``percentile`` gathers the frame's values anew for each row. Here each entity's rows come
in order to one function, in Arrow batches; what it holds between batches is the window, never the series, so an
entity of any length is read in bounded memory. Values are held in blocks of some dozens, as in a two-level sorted
list: a value is put in or taken out with two binary searches and a move within one small block, so a row's cost
hardly depends on the window's length."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a block; a block of twice as many is cut in two.
BLOCK = 64


class SortedWindow:
    """A multiset of numbers that knows its middle."""

    def __init__(self):
        self.blocks: list[list[float]] = []
        self.tops: list[float] = []  # the last value of each block
        self.size = 0

    def add(self, v: float) -> None:
        self.size += 1
        if not self.blocks:
            self.blocks, self.tops = [[v]], [v]
            return
        i = min(bisect_left(self.tops, v), len(self.blocks) - 1)
        block = self.blocks[i]
        insort(block, v)
        self.tops[i] = block[-1]
        if len(block) > 2 * BLOCK:
            self.blocks[i : i + 1] = block[:BLOCK], block[BLOCK:]
            self.tops[i : i + 1] = block[BLOCK - 1], block[-1]

    def remove(self, v: float) -> None:
        """Takes one value that equals ``v`` out; it must be there."""
        self.size -= 1
        i = bisect_left(self.tops, v)
        block = self.blocks[i]
        del block[bisect_left(block, v)]
        if block:
            self.tops[i] = block[-1]
        else:
            del self.blocks[i], self.tops[i]

    def _at(self, k: int) -> float:
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)
        raise IndexError(k)

    def median(self) -> float:
        half = self.size // 2
        return self._at(half) if self.size % 2 else (self._at(half - 1) + self._at(half)) / 2


class RollingMedian:
    """Medians of the last ``window`` pushed values (None or NaN: no value); None where fewer than ``least`` are there."""

    def __init__(self, window: int, least: int):
        self.window, self.least = window, least
        self.held: deque[float | None] = deque()
        self.sorted = SortedWindow()

    def push(self, v: float | None) -> float | None:
        if v is not None and v != v:
            v = None
        self.held.append(v)
        if v is not None:
            self.sorted.add(v)
        if len(self.held) > self.window:
            old = self.held.popleft()
            if old is not None:
                self.sorted.remove(old)
        return self.sorted.median() if self.sorted.size and self.sorted.size >= self.least else None


class MedianAndDeviation:
    """Row by row: the rolling median of a series and that of the values' distances from the medians at their own rows.

    ``lag``: rows by which the values trail the rows that they are for (1: strictly earlier rows). ``ahead``: rows of
    the frame that follow a row, so results come so many rows late, and the last ones when the series ends."""

    def __init__(self, window: int, least: int, lag: int = 0, ahead: int = 0):
        self.medians, self.deviations = RollingMedian(window, least), RollingMedian(window, least)
        self.late: deque[float | None] = deque([None] * lag)
        self.ahead = ahead
        self.values: deque[float | None] = deque()  # that wait for the median of their row
        self.med: deque[float | None] = deque()  # that wait for the deviation of their row
        self.pushed = self.deviated = 0

    def _median(self, v: float | None) -> Iterator[tuple[float | None, float | None]]:
        m = self.medians.push(v)
        self.pushed += 1
        if self.pushed > self.ahead:
            own = self.values.popleft()
            self.med.append(m)
            yield from self._deviation(abs(own - m) if own is not None and m is not None else None)

    def _deviation(self, d: float | None) -> Iterator[tuple[float | None, float | None]]:
        mad = self.deviations.push(d)
        self.deviated += 1
        if self.deviated > self.ahead:
            yield self.med.popleft(), mad

    def push(self, v: float | None) -> Iterator[tuple[float | None, float | None]]:
        """(median, median deviation) of the rows that are now known."""
        v = None if v is not None and v != v else v
        self.late.append(v)
        v = self.late.popleft()
        self.values.append(v)
        yield from self._median(v)

    def end(self) -> Iterator[tuple[float | None, float | None]]:
        """The rows at the end, whose frames reach beyond it."""
        for _ in range(self.ahead):
            if self.values:
                yield from self._median(None)
        while self.med:
            yield from self._deviation(None)


def rolling_median_mad(df: DataFrame, x: str, window: int, least: int, lag: int = 0, ahead: int = 0) -> DataFrame:
    """Adds __med and __mad to each row of (entity, idx, ...): the median of x over a frame of ``window`` rows that ends ``ahead`` rows
    after the row (of the values ``lag`` rows earlier), and the median distance, over the same frame, of each value from the median at its own row. Null
    values are skipped; with fewer than ``least`` there is no median. The rows of an entity are one sorted stretch of a partition."""
    # a null entity is one of its own, and names may clash with nothing that callers have
    names = df.columns
    ordered = df.withColumn("__x", F.col(x).cast("double")).repartition("entity").sortWithinPartitions("entity", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, entity, begun = None, None, False
        waiting: deque[pa.RecordBatch] = deque()  # batches whose rows are not all known
        found: list[tuple[float | None, float | None]] = []

        def ready() -> Iterator[pa.RecordBatch]:
            while waiting and len(found) >= waiting[0].num_rows:
                b = waiting.popleft()
                some, found[:] = found[: b.num_rows], found[b.num_rows :]
                cols = [pa.array([r[i] for r in some], pa.float64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*names, "__med", "__mad"])

        for b in batches:
            if not b.num_rows:
                continue
            waiting.append(b)
            for e, v in zip(b.column(where).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if not begun or e != entity:
                    if begun:
                        found.extend(state.end())
                    state, entity, begun = MedianAndDeviation(window, least, lag, ahead), e, True
                found.extend(state.push(v))
            yield from ready()
        if begun:
            found.extend(state.end())
        yield from ready()

    where = [c.lower() for c in names].index("entity")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return ordered.mapInArrow(run, f"{schema}, `__med` double, `__mad` double")
