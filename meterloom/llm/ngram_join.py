"""N-gram Jaccard join: MinHash banding, then verification on the full shingle sets.

Texts with the same set of five-word shingles are one *class*; only classes are joined, so copies
cost one row each. A class gets one key per band; bands and rows follow from the target recall.
Buckets (equal band keys) of two or more classes are candidates. Buckets with the same members
are one (their members' hashes are summed to tell), so two near copies that share many bands meet
once. A bucket of many or long members is cut into blocks, each pair of blocks a unit of its own of
bounded size: no bucket has to fit in one task, and no member or pair is dropped. A pair that
several units hold is counted in the one with the smallest common bucket. Units give sums and
spanning edges, never lists of pairs. Of the corpus' texts, only one for each class with candidates is
shuffled: a bitmap of bounded size sifts the documents first, where they are read.

Shingles: five whitespace-separated words (space, \\t, \\n, \\v, \\f, \\r), case kept; a text of 1 to 4
words is one shingle; a null text, or one without words, has no shingle and links with nothing.
Rows that repeat, doc_id included, are documents like others. Shingles are compared as 64-bit
hashes; two of a pair of texts collide with a chance of about n*n/2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, null_safe, released, sieve, sifted, stored
from .shingles import MinHash, Words, bands_for, shingle_set

#: A unit holds up to twice so many classes, and twice so many shingles.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1_000_000


def signatures(docs: DataFrame, threshold: float, recall: float, n: int) -> DataFrame:
    """(doc_id, text_hash, cls, n_shingles, bands) per row; cls and bands are null without words."""
    b, r = bands_for(threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mh = Words(), MinHash(b, r)
        import xxhash

        for batch in batches:
            texts = batch.column(2)
            cls, size, keys = [], [], []
            for i in range(len(texts)):
                t = texts[i].as_py()
                s = shingle_set(words.of(t.split()), n) if t else np.empty(0, np.uint64)
                if len(s):
                    cls.append(int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)))
                    keys.append(mh.keys(s))
                else:
                    cls.append(None)
                    keys.append(None)
                size.append(len(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "cls", "n_shingles", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, cls long, n_shingles long, bands array<long>")


def _candidates(classes: DataFrame) -> DataFrame:
    """(unit, part, cls, copies, canons): members of units; part 0 or 1 says which block a member is
    in where the unit is a pair of two blocks, and 2 where it is one block."""
    member = classes.select("cls", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = member.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).cast("decimal(38,0)").alias("sig")
    )
    buckets = stored(buckets.where("n > 1"), "buckets")
    # buckets of the same members become one
    groups = stored(buckets.groupBy("n", "lo", "hi", "sig").agg(F.min("bucket").alias("canon"), F.max("s").alias("s")), "groups")
    named = buckets.select("bucket", "n", "lo", "hi", "sig").join(groups, ["n", "lo", "hi", "sig"]).select("bucket", "canon", "n", "s")
    named = stored(named, "named")
    of = member.select("cls", "bucket").join(named, "bucket").select("cls", "canon", "n", "s").distinct()
    of = stored(of, "members")
    canons = of.groupBy("cls").agg(F.sort_array(F.collect_set("canon")).alias("canons"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    rows = of.withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64("cls", "canon"), F.col("nb")).cast("int"))
    rows = rows.select("cls", "canon", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    rows = rows.select(
        "cls",
        F.xxhash64("canon", F.least("blk", "other"), F.greatest("blk", "other")).alias("unit"),
        "canon",
        F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") < F.col("other"), 0).otherwise(1).alias("part"),
    )
    units = stored(rows.join(canons, "cls"), "units")
    released(buckets, groups, named, of)
    return units


def links_in_unit(sets: list[np.ndarray], part: np.ndarray, canon: int, canons: list[np.ndarray], threshold: float) -> np.ndarray:
    """The matrix of links that this unit counts: similarity at least ``threshold``, members of the
    two blocks (or both of the one block), and no smaller common bucket."""
    m = len(sets)
    if m > 1:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(m), [len(s) for s in sets])
        _, at, often = np.unique(flat, return_inverse=True, return_counts=True)
        keep = often[at] > 1  # others are in one set only
        at, owner = at[keep], owner[keep]
        _, at = np.unique(at, return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        both, width = np.zeros((m, m), np.float32), 4096
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            a, b = np.searchsorted(at, [lo, lo + width])
            x = np.zeros((m, width), np.float32)
            x[owner[a:b], at[a:b] - lo] = 1
            both += x @ x.T
        sizes = np.array([len(s) for s in sets], np.float64)
        either = sizes[:, None] + sizes[None, :] - both
        linked = both >= threshold * either - 1e-9
    else:
        linked = np.zeros((m, m), bool)
    np.fill_diagonal(linked, False)
    two = part < 2
    if two.any():
        linked &= part[:, None] != part[None, :]
    for i, j in zip(*np.nonzero(np.triu(linked))) if any(len(c) > 1 for c in canons) else ():
        a, b = canons[i], canons[j]
        if a[0] < canon and b[0] < canon and np.intersect1d(a, b, assume_unique=True)[0] < canon:
            linked[i, j] = linked[j, i] = False
    return linked


def spanning(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches."""
    lab = np.arange(len(linked))
    while True:
        low = np.minimum(lab, np.where(linked, lab[None, :], len(lab)).min(axis=1, initial=len(lab)))
        low = low[low]
        if (low == lab).all():
            return lab
        lab = low


def verified(units: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """(cls, links, root): for each member with links in a unit, their number in documents, and the
    first member of its component there. texts: (cls, copies, text), a row for each class."""
    rows = units.join(texts, "cls").repartition("unit").sortWithinPartitions("unit")

    def run(batches):
        import pandas as pd

        words, held = Words(), []

        def done(rows):
            cls, copies = np.array([r[0] for r in rows]), np.array([r[4] for r in rows])
            sets = [shingle_set(words.of(r[5].split()), n) for r in rows]
            linked = links_in_unit(sets, np.array([r[2] for r in rows]), rows[0][1], [r[3] for r in rows], threshold)
            has = linked.any(axis=1)
            return cls[has], (linked @ copies)[has], cls[spanning(linked)][has]

        def table(out):
            return pd.DataFrame({"cls": np.concatenate([x[0] for x in out]), "links": np.concatenate([x[1] for x in out]), "root": np.concatenate([x[2] for x in out])})

        unit = None
        for pdf in batches:
            out = []
            for u, *row in zip(pdf["unit"], pdf["cls"], pdf["canon"], pdf["part"], pdf["canons"], pdf["copies"], pdf["text"]):
                if u != unit and held:
                    if len(held) > 1:
                        out.append(done(held))
                    held = []
                unit = u
                held.append(row)
            if out:
                yield table(out)
        if len(held) > 1:
            yield table([done(held)])

    cols = rows.select("unit", "cls", "canon", "part", "canons", "copies", "text")
    return cols.mapInPandas(run, "cls long, links long, root long")


def ngram_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(signature rows, classes): per class cls, copies, class_id (smallest doc_id of its rows),
    links (documents of other classes that are linked directly) and component (a cls)."""
    rows = stored(signatures(docs, threshold, recall, n), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("class_id"), F.min(row).alias("row"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    classes = stored(classes, "classes")
    units = _candidates(classes)
    # the text of one row for each class that has a candidate
    wanted = units.select("cls").distinct().join(classes, "cls").select("cls", "copies", F.col("row.doc_id").alias("row_id"), F.col("row.text_hash").alias("row_hash"))
    wanted = stored(wanted, "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    texts = sifted(texts, F.xxhash64("doc_id", "text_hash"), sieve(wanted.select(F.xxhash64("row_id", "row_hash").alias("key"))))
    # a merge join: there may be any number of candidates, and all have texts
    texts = null_safe(texts, wanted.hint("merge"), {"doc_id": "row_id", "text_hash": "row_hash"}, "inner").groupBy("cls", "copies").agg(F.first("text").alias("text"))
    found = stored(verified(units, texts, threshold, n), "found")
    released(units, wanted)
    comp = components(found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    every = classes
    classes = classes.select("cls", "copies", "class_id").join(links, "cls", "left").join(comp.withColumnRenamed("id", "cls"), "cls", "left")
    linked = stored(classes.select("cls", "copies", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component")), "linked")
    released(every, found)
    return rows, linked


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, n: int = 5) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id with the same shingles), n_copies (rows
    of that class), n_links (other documents linked directly, copies included), component_id (smallest
    doc_id reachable by links)."""
    rows, classes = ngram_join(docs, threshold, recall, n)
    least = stored(classes.groupBy("component").agg(F.min("class_id").alias("component_id")), "least")
    info = stored(classes.join(least, "component").select("cls", "class_id", "component_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links")), "info")
    out = rows.select("doc_id", "cls").join(info, "cls", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, n: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then text
    hash. Rows without words stay. All columns, whatever their names, are kept. Rows of components of
    their own stay where they are read; only the others are shuffled."""
    rows, classes = ngram_join(docs, threshold, recall, n)
    part = rows.where("cls is not null").groupBy("cls", "doc_id", "text_hash").agg(F.count("*").alias("times")).join(classes.select("cls", "component"), "cls")
    part = stored(part.select("component", "doc_id", "text_hash", "times"), "rows")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    groups = stored(part.groupBy("component").agg(F.sum("times").alias("n"), F.min(row).alias("row")).where("n > 1"), "groups")
    stays = F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("text_hash") == F.col("row.text_hash"))
    new = {c: fresh(docs, f"__nj_{c}") for c in ("doc_id", "text_hash", "stays", "times", "i", "h")}
    judged = part.join(groups, "component").withColumn("stays", stays)
    judged = stored(judged.select(*[F.col(c).alias(new[c]) for c in ("doc_id", "text_hash", "stays", "times")]), "judged")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    through = sieve(judged.select(F.xxhash64(new["doc_id"], new["text_hash"]).alias("key")))
    alone = sifted(docs, key, through, inside=False)
    met = sifted(docs, key, through).withColumns({new["i"]: F.col("doc_id").cast("long"), new["h"]: F.xxhash64("text")})
    met = null_safe(met, judged.hint("merge"), {new["i"]: new["doc_id"], new["h"]: new["text_hash"]}, "left").where(F.coalesce(F.col(new["stays"]), F.lit(True)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = alone.unionByName(met.where(F.coalesce(F.col(new["times"]), F.lit(1)) == 1).select(*names))
    if judged.where(F.col(new["stays"]) & (F.col(new["times"]) > 1)).isEmpty():
        return out
    return out.unionByName(met.where(F.col(new["times"]) > 1).dropDuplicates([new["i"], new["h"]]).select(*names))
