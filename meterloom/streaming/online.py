"""The online detector: calendar-slot z scores by a frozen profile, judged by the strictly trailing
flagger, row after row of each entity in the order of their times. Rows wait until the watermark has passed them, so
those that come out of order, in one micro-batch or in several, are judged in order. State is
the rows that wait and a ring of the last ``window`` scores and distances; it needs a state store that keeps lists (RocksDB)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.windows import MAD, TINY, Z99

#: The state store that the detector needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Trailing:
    """The trailing flagger with its history; NaN stands for missing values and takes a place."""

    def __init__(self, window: int = 336, least: int | None = None, level: float = Z99, scores=(), devs=()):
        self.window, self.least, self.level = window, least or window // 4, level
        self.scores, self.devs = list(scores), list(devs)

    def _median(self, v: list[float]) -> float:
        a = np.asarray(v[-self.window :], float)
        a = a[~np.isnan(a)]
        return float(np.median(a)) if len(a) >= self.least else np.nan

    def push(self, s: float) -> tuple[float, float, bool]:
        """(mad, z, flag) of the next score, by what came before it; then it joins the history.

        A distance is that of the latest past score from the median at this row."""
        med = self._median(self.scores)
        self.devs.append(abs(self.scores[-1] - med) if self.scores else np.nan)
        mad = MAD * self._median(self.devs)
        z = (s - med) / (mad + TINY)
        self.scores.append(s)
        del self.scores[: -self.window], self.devs[: -self.window]
        return mad, z, bool(z > self.level)


class OnlineFlags(StatefulProcessor):
    """Of one entity: waiting rows (list), the ring of scores and distances (value), and a timer for the
    earliest waiting row."""

    def __init__(self, window: int, least: int | None):
        self.window, self.least = window, least

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, s double")
        self.ring = handle.getValueState("ring", "scores array<double>, devs array<double>, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.ring.get()[2] if self.ring.exists() else None
        first = None
        for pdf in rows:  # one piece after another; what was judged can't be taken back
            new = [(int(at), None if pd.isna(s) else float(s)) for at, s in zip(pdf["at"], pdf["s"]) if last is None or at > last]
            if new:
                self.waiting.appendList(new)
                first = min(new)[0] if first is None else min(first, min(new)[0])
        if first is not None:
            self.handle.registerTimer(first // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        due, rest = [], []
        for at, s in self.waiting.get():
            (due if at <= now else rest).append((at, s))
        if due:
            scores, devs, last = self.ring.get() if self.ring.exists() else ((), (), None)
            some = lambda v: [np.nan if x is None else x for x in v]
            t, out = Trailing(self.window, self.least, scores=some(scores), devs=some(devs)), []
            for at, s in sorted(due, key=lambda r: r[0]):
                if last is None or at > last:  # of rows of one time, the first counts
                    out.append((key[0], at, s, *t.push(np.nan if s is None else s)))
                    last = at
            known = lambda v: [None if np.isnan(x) else float(x) for x in v]
            self.ring.update((known(t.scores), known(t.devs), last))
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(rest)[0] // 1000)
            yield pd.DataFrame(out, columns=["entity", "at", "s", "mad", "z", "flag"]).astype({"s": float})

    def close(self) -> None:
        pass


def online_flags(stream: DataFrame, profile: DataFrame, slot, window: int = 336, least: int | None = None, delay: str = "1 hour") -> DataFrame:
    """(entity, ts, s, mad, z, flag) of a stream (entity, ts, x): each row once the watermark, ``delay`` behind the
    latest row, has reached it.

    ``profile``: (entity, slot, med, mad), frozen. Rows behind the watermark, or no later than an entity's last judged row, are dropped."""
    x = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("slot", slot(F.col("ts")))
    scored = x.join(profile, ["entity", "slot"], "left").select("entity", "ts", F.unix_micros("ts").alias("at"), ((F.col("x") - F.col("med")) / (F.col("mad") + TINY)).alias("s"))
    out = scored.groupBy("entity").transformWithStateInPandas(OnlineFlags(window, least), "entity string, at long, s double, mad double, z double, flag boolean", "Append", "EventTime")
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("entity", F.timestamp_micros("at").alias("ts"), known("s"), known("mad"), known("z"), "flag")


def windowed(stream: DataFrame, ts: str, key: str, value: str, length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Event-time tumbling or sliding sums and counts, late rows dropped behind the watermark."""
    w = F.window("__ts", length, slide) if slide else F.window("__ts", length)
    x = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    out = x.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Event-time sessions: (start, end, key, n)."""
    x = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    out = x.groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
