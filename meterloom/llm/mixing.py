"""Mixing sources to target weights, with DataFrame operations only.

Sizes (words) are summed per source; each source's target follows from its weight, capped at a
multiple of its own size, the excess going to the others by weight; target / size is the source's
repetition rate. A document is taken floor(rate) times, and once more if a number from the hash of its
doc_id, text, source and a seed is below the rate's fraction. Rows that are equal in these three are numbered, and the
number is hashed too, so that each has a draw of its own. Results don't depend on row order or partitioning, but
for which of such equal rows has which draw.

Sources are ordered by code point, null last (the null source is a source); they take the weights in
turn. A null text has size 0; a null doc_id, text or source hashes like the text "null". Sources without words have target 0
and rate 0 while there are words elsewhere. Very long texts are read whole; an empty table gives no rows; other columns, of
whatever names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, null_safe, small, stored

WEIGHTS = (1, 2, 3)
MOST = 3


def identity(doc_id: Column, text: Column, source: Column) -> Column:
    """What tells documents apart: id, text (its MD5 value) and source."""
    null = F.lit("null")
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), null), F.coalesce(F.md5(text), null), F.coalesce(source, null))


def draw(key: Column, number: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 value."""
    h = F.md5(F.concat(key, F.lit("|"), number.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def numbered(docs: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``: rows of one ``key`` are counted from 1. Few rows have a key that others have, and only these move. They are counted
    within the partitions that they come from, which are then shifted by the counts before: a key that a third
    of all rows have is many groups."""
    keyed = docs.select(F.col(key).alias("k"), F.spark_partition_id().alias("p"))
    counts = stored(keyed.groupBy("k", "p").agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("k"))).where("n > 1"), "repeated-rows")
    if counts.isEmpty():
        return docs.withColumn(out, F.lit(1).cast("long"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tmp = {c: fresh(docs, c) for c in ("__k", "__p", "__q", "__before")}
    shift = small(stored(counts.select(F.col("k").alias(tmp["__k"]), F.col("p").alias(tmp["__p"]), before.alias(tmp["__before"])), "repeated-shifts"))
    at = docs.withColumn(tmp["__q"], F.spark_partition_id())
    joined = at.join(shift, (F.col(key) == F.col(tmp["__k"])) & (F.col(tmp["__q"]) == F.col(tmp["__p"])), "left")
    alone = joined.where(F.col(tmp["__before"]).isNull()).withColumn(out, F.lit(1).cast("long"))
    own = F.row_number().over(Window.partitionBy(key, tmp["__q"]).orderBy(F.lit(1)))
    several = joined.where(F.col(tmp["__before"]).isNotNull()).withColumn(out, (F.col(tmp["__before"]) + own).cast("long"))
    return alone.unionByName(several).drop(*tmp.values())


def ranked(sources: DataFrame) -> DataFrame:
    """Adds i, the 0-based rank by code point, null last, however many sources there are: ranges of
    sources are numbered within themselves and shifted by the sizes of the ranges before."""
    n = max(1, sources.sparkSession.sparkContext.defaultParallelism)
    key = [F.col("source").isNull(), F.col("source")]
    placed = stored(sources.repartitionByRange(n, *key).withColumn("range", F.spark_partition_id()), "source-ranges")
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))  # one row a range
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*key)) - 1
    return placed.withColumn("own", own).join(F.broadcast(before.select("range", "before")), "range").withColumn("i", F.col("before") + F.col("own")).drop("range", "own", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    turn = F.array(*map(F.lit, weights))
    table = stored(ranked(sources).withColumn("w", F.element_at(turn, (F.col("i") % len(weights) + 1).cast("int")).cast("long")), "source-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # each round caps the sources above their limit and shares the rest anew; sums are whole numbers
    rest, weight, capped = total, 1, -1
    full = F.lit(False)
    while True:
        got = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0)).alias("w"), F.count(F.when(full, 1)).alias("n")
        ).first()
        rest, weight = total - got["c"], max(got["w"], 1)
        if got["n"] == capped:
            break
        capped = got["n"]
        dec = "decimal(38,0)"
        full = full | (F.lit(rest).cast(dec) * F.col("w") > F.col("source_size").cast(dec) * most * weight)
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(F.lit(float(rest)) * F.col("w") / F.lit(float(weight)))
    return table.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", prefix: str = "mix_") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns size, source_size, target and copies, and the names that these have: with
    ``prefix``, and underscores after them where ``docs`` has such a column."""
    new = {c: fresh(docs, prefix + c) for c in ("size", "source_size", "target", "copies", "key", "source", "identity", "number")}
    sized = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.col("source").cast("string")
    sources = stored(docs.select(name.alias("source"), sized.alias("n")).groupBy("source").agg(F.sum("n").alias("source_size")), "sources")
    plan = stored(targets(sources, weights, most), "targets")
    plan = plan.select(*[F.col(c).alias(new[c]) for c in ("source", "source_size", "target")])
    rows = docs.withColumn(new["key"], name)
    rows = numbered(rows.withColumn(new["identity"], identity(F.col("doc_id"), F.col("text").cast("string"), F.col(new["key"]))), new["identity"], new["number"])
    out = null_safe(rows, small(plan), {new["key"]: new["source"]}, "left")
    rate = F.when(F.col(new["source_size"]) > 0, F.col(new["target"]) / F.col(new["source_size"])).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    more = draw(F.col(new["identity"]), F.col(new["number"]), seed) < rate - whole
    return out.withColumn(new["size"], sized).withColumn(new["copies"], (whole + more.cast("long")).cast("long")).drop(new["key"], new["source"], new["identity"], new["number"]), new


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns, whatever their names, are kept."""
    out, new = mix(docs, **how)
    copies = F.col(new["copies"])
    one = out.where(copies > 0).withColumn(new["key"], F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])
