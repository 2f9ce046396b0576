"""What the training-data operators share: bounded broadcasts and bitmaps,
connected components, and helpers for reading Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import released, stored

#: A word is a maximal run of characters other than these (space, \t, \n, \v, \f, \r).
WORD = r"[^\x20\x09-\x0D]+"

#: A table may be broadcast up to this many (narrow) rows; its size is counted first.
BROADCAST_ROWS = 20_000

#: Python code takes texts from an Arrow batch in pieces of about so many bytes.
PIECE_BYTES = 8 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else unchanged (the join then
    shuffles, and adaptive execution splits skewed partitions). Pass a stored table: it is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long ids: (id, component), where component
    is the smallest id reachable. Rounds of minimum-label spreading and pointer jumping, each a
    stored table; no edge list reaches the driver, only the number of changes does.

    Nodes without edges aren't returned; self-loops are nodes of their own."""
    both = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    both = stored(both.union(both.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("low"))
        spread = stored(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "low").alias("label")), "spread")
        up = spread.select(F.col("id").alias("up"), F.col("label").alias("top"))
        before, labels = labels, stored(spread.join(up, spread.label == up.up).select("id", "old", F.col("top").alias("label")), "labels")
        released(before, spread)
        if labels.where("label <> old").isEmpty():
            released(both)
            return labels.select("id", F.col("label").alias("component"))


#: Bits of a sieve for each key, and its most bits (64 MB).
SIEVE_BITS, MOST_BITS = 16, 1 << 29
_PAGE = 1 << 15


def sieve(keys: DataFrame) -> tuple[DataFrame, int]:
    """A bitmap of the 64-bit hashes in the column ``key`` of a stored table, as pages to broadcast, and its
    number of bits: 16 for each key, 2**29 (64 MB) at most. Many more keys than that only make it let more through."""
    bits = 1 << 18
    while bits < min(SIEVE_BITS * keys.count(), MOST_BITS):
        bits *= 2
    at = F.pmod("key", F.lit(bits))
    pages = keys.select(F.floor(at / _PAGE).alias("__page"), (at % _PAGE).alias("bit"))
    return stored(pages.groupBy("__page").agg(F.bitmap_construct_agg("bit").alias("__bits")), "sieve"), bits


def sifted(df: DataFrame, key: Column, through: tuple[DataFrame, int], inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose key is in the sieve (with a few others), or those whose key certainly isn't."""
    pages, bits = through
    names, (tmp, page, own) = df.columns, (fresh(df, c) for c in ("__at", "__page", "__bits"))
    at = F.col(tmp) % _PAGE
    pages = F.broadcast(pages.select(F.col("__page").alias(page), F.col("__bits").alias(own)))
    joined = df.withColumn(tmp, F.pmod(key, F.lit(bits))).join(pages, F.floor(F.col(tmp) / _PAGE) == F.col(page), "left")
    byte = F.conv(F.hex(F.substring(F.col(own), (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    has = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return joined.where(has if inside else ~has).select(*[F.col(f"`{c}`") for c in names])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(sizes: list[int], most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbours whose sizes sum to at most ``most`` (one larger item is alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str) -> DataFrame:
    """Join on several keys, nulls equal to nulls."""
    on = None
    for x, y in keys.items():
        c = left[x].eqNullSafe(right[y])
        on = c if on is None else on & c
    return left.join(right, on, how)
