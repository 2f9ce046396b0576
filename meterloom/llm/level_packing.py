"""Online packing of documents by the sum-of-squares rule.

Documents come one by one. Each task keeps a level array: how many of its open windows are filled to each
level from 1 to ``most`` - 1. A document goes to the level (or into a new window) that leaves the least sum
of squared counts, the fullest such level among equals, so no level piles up and most windows get filled to
the end. Documents of more than ``most`` tokens first fill windows of their own; their last piece is placed
like a document.

Open windows are closed at a task's end, and in between when there are ``MOST_OPEN`` of them (32 MB of ids):
what lies in the emptiest windows is cut to fill the gaps of the fullest. The last window is cut into lengths that are
powers of two, which need no padding, so there is none at all; only closing cuts documents that fit a window.

Tasks share nothing, so nothing is shuffled, collected or broadcast but the vocabulary file; a task that is
run again gives the same rows. Sequence numbers hold the task's number in their upper bits.

A null text is empty; a document without tokens still has its end-of-text id and so one piece. Repeated rows
are documents like others, null doc_ids too. Very long texts are read whole. Other columns of whatever names
are ignored; an empty table gives no rows. Ties go to the fullest level.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import END_ID, tokenizer_here

MAX_LEN = 2048
#: Windows that a task holds open at most.
MOST_OPEN = 4096
#: Sequences of one task at most.
TASK_SEQUENCES = 1 << 38

#: A piece: (doc_id, start, doc_tokens, ids as bytes of 32-bit numbers).
Piece = tuple
SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class LevelArray:
    """The open windows of one task, by fill level."""

    def __init__(self, most: int):
        self.most = most
        # count[h]: open windows filled to h. The ends stand for a new window and a full one: with them, the
        # change of the sum of squares is 2 * (count[h + s] - count[h]) + 2 for every choice.
        self.count = np.zeros(most + 1)
        self.count[0], self.count[most] = 0.5, -0.5
        self.taken = np.full(most + 1, -np.inf)  # the same where there is a window to take, else -inf
        self.taken[0] = 0.5
        self.windows: list[list[list[Piece]]] = [[] for _ in range(most + 1)]
        self.open = 0

    def _set(self, level: int, step: int) -> None:
        self.count[level] += step
        self.taken[level] = self.count[level] if self.count[level] > 0 else -np.inf
        self.open += step

    def level_for(self, size: int) -> int:
        """The level whose window a piece of ``size`` tokens should take; 0 is a new window."""
        cost = self.count[size:] - self.taken[: self.most + 1 - size]
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def place(self, size: int, piece: Piece) -> list[Piece] | None:
        """Puts the piece in; returns the window if that fills it."""
        level = self.level_for(size)
        window = []
        if level:
            window = self.windows[level].pop()
            self._set(level, -1)
        window.append(piece)
        if level + size == self.most:
            return window
        self.windows[level + size].append(window)
        self._set(level + size, 1)
        return None

    def drain(self) -> list[list[Piece]]:
        """Takes all open windows out, fullest first."""
        out = [w for level in range(self.most - 1, 0, -1) for w in self.windows[level]]
        for level in range(1, self.most):
            if self.windows[level]:
                self._set(level, -len(self.windows[level]))
                self.windows[level] = []
        return out


def closed(windows: list[list[Piece]], most: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """(sequences, left over): open windows, fullest first, filled with what the emptiest hold. Pieces are
    cut at a gap's end. What fills no window is left over; if ``last``, it is cut into powers of two."""
    size = lambda p: len(p[3]) // 4
    loose: list[Piece] = []  # pieces of the emptiest windows, to be taken from the end
    out, first, end = [], 0, len(windows)

    def take(need: int) -> list[Piece]:
        got = []
        while need:
            p = loose.pop()
            if size(p) > need:
                doc, start, total, ids = p
                loose.append((doc, start + need, total, ids[4 * need :]))
                p = (doc, start, total, ids[: 4 * need])
            got.append(p)
            need -= size(p)
        return got

    held = 0
    while first < end or held >= most:
        room, window = most, []
        if first < end:
            window = windows[first]
            room -= sum(map(size, window))
            first += 1
        while held < room and first < end:
            end -= 1
            loose += windows[end]
            held += sum(map(size, windows[end]))
        if held < room:
            loose += window
            held += most - room
            break
        out.append(window + take(room))
        held -= room
    if not last:
        return out, loose
    for bit in range(most.bit_length() - 1, -1, -1):
        if held >> bit & 1:
            out.append(take(1 << bit))
    return out, []


def packed_batches(documents: Iterator[tuple[int | None, bytes]], most: int, first_sequence: int) -> Iterator[pa.RecordBatch]:
    """The rows of SCHEMA for documents given as (doc_id, ids as bytes)."""
    levels, sequence = LevelArray(most), first_sequence
    rows: list[tuple] = []

    def emit(window: list[Piece]) -> None:
        nonlocal sequence
        offset = 0
        for doc, start, total, ids in window:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))
            offset += len(ids) // 4
        sequence += 1

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=SCHEMA)

    for doc, ids in documents:
        total = len(ids) // 4
        for start in range(0, total, most):
            part = ids[4 * start : 4 * (start + most)]
            if len(part) == 4 * most:
                emit([(doc, start, total, part)])
            elif (full := levels.place(len(part) // 4, (doc, start, total, part))) is not None:
                emit(full)
        if levels.open >= MOST_OPEN:
            done, left = closed(levels.drain(), most, last=False)
            for window in done:
                emit(window)
            for p in left:
                if (full := levels.place(len(p[3]) // 4, p)) is not None:
                    emit(full)
        if len(rows) >= 10_000:
            yield batch()
    for window in closed(levels.drain(), most, last=True)[0]:
        emit(window)
    if rows:
        yield batch()


def pack_online(docs: DataFrame, tokenizer_path: str, most: int = MAX_LEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece of all rows."""
    if most & (most - 1):
        raise ValueError("the windows' length must be a power of two")
    with open(tokenizer_path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                tok = tokenizer_here(file.value)
                ids, text = batch.column(0), batch.column(1)
                for i in range(batch.num_rows):
                    yield ids[i].as_py(), tok.ids([text[i].as_py() or ""])[0] + end

        yield from packed_batches(documents(), most, TaskContext.get().partitionId() * TASK_SEQUENCES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in SCHEMA.names))
