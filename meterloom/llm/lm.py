"""Language-model scoring with a weighted backoff automaton.

Model, of any order n (3 by default): words (ASCII letters lower-cased) and an end token;
p1(w) = (c(w) + a) / (N + a (V + 1)), and for a context h of k words, h' being h without its first word,
p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m), where m is the prior weight of contexts of k words (the
Dirichlet prior: m words' worth of the shorter context). Written as an automaton: a state for each
context of up to n - 1 words seen in training, and the root. State h has an arc for each n-gram (h, w)
seen, with log p(w | h), and a failure arc to h' with log(m / (c(h) + m)); failure arcs so form chains
that end at the root, whose arcs have log p1. Reading w leads to the longest suffix of (h, w) that is
a state. A text begins at the root. Each m is fitted: of the values of a fixed grid, the one with the
highest leave-one-out likelihood of the training texts.

Distribution: documents are gathered in blocks of bounded size. A block asks for the counts of its
distinct n-grams, as 64-bit hashes dealt into buckets by hash; a bucket adds up what blocks counted and
answers only for the n-grams that two blocks or more have (a block knows the counts of the others). One
round asks for words and pairs, one more for each higher order, and there only for n-grams whose first
and last n - 1 words are both in other blocks too: others can't be. All training texts are counted,
whatever the size: no pruning, no cut-offs, no vocabulary limit. A block sends each distinct n-gram
at most once and a message at most for each of them, so messages are linear in the tokens; every n-gram
goes to the bucket of its hash, so frequent words are no hot spots. Two n-grams share a hash with a chance
of about n*n/2**65 (3e-8 for a million, 3e-2 for 10**9).

A null text is empty: it has the end token only. A document is held out if crc32 of its doc_id as text
is divisible by 10; rows with a null doc_id train. Repeated rows all count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored
from .shingles import mix as scramble

ADD = 0.1
GRID = (1.0, 10.0, 100.0, 1e3, 1e4, 1e5, 1e6, 1e7)
#: A block ends once it has so many tokens (or at a partition's end); there is a bucket for so many tokens.
BLOCK_TOKENS, BUCKET_TOKENS = 1_500_000, 3_000_000
END = b" end"  # no word has a blank
NO, LOW = np.int32(-1), np.int64(0xFFFFFFFF)

BLOCK = "block string, doc_ids array<long>, outs array<boolean>, n_tokens array<long>, words binary, tokens binary"
#: Requests; level -1 has sums of log-likelihoods (``fit``) instead.
REQUEST = "level int, bucket int, block string, keys binary, counts binary, fit array<double>"
#: Answers: which of the keys asked for have a count of other blocks too (bits), and those counts.
ANSWER = "level int, bucket int, block string, shared binary, counts binary, n_distinct long"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, fit array<double>"


def _squeeze(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, by planes of equal significance."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unsqueeze(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _arrow(rows: list[tuple], schema: str) -> pa.Table:
    """A table of rows; ``schema`` has Spark's names of the types."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds |= {f"array<{k}>": pa.list_(t) for k, t in kinds.items()}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")))
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(cols, types)], names=list(names))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def blocks_of(docs: DataFrame) -> DataFrame:
    """A row for each block: its documents (doc_id, whether held out, tokens), its words' hashes, and
    its tokens as numbers of those words; number 0 is the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty():
            return {END: 0}, [], [], [], 0

        def row(words, ids, outs, toks):
            n = [len(t) for t in toks]
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            # no two tasks, nor two tries of one, share a name; only one try's rows are written
            return _arrow([(uuid.uuid4().hex, ids, outs, n, h.tobytes(), _squeeze(np.concatenate(toks)))], BLOCK).to_batches()[0]

        words, ids, outs, toks, total = empty()
        for batch in batches:
            doc, text = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                t, d = (text[i].as_py() or b"").lower().split(), doc[i].as_py()
                at = np.fromiter([words.setdefault(w, len(words)) for w in t], np.int32, len(t))
                toks.append(np.append(at, np.int32(0)))
                ids.append(d)
                outs.append(held_out(d))
                total += len(t) + 1
                if total >= BLOCK_TOKENS:
                    yield row(words, ids, outs, toks)
                    words, ids, outs, toks, total = empty()
        if ids:
            yield row(words, ids, outs, toks)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, BLOCK)


class Grams:
    """The distinct k-grams of a block: which one ends at each token (-1: none, its text being too
    young), their hashes, first and last k - 1 words (as (k-1)-grams), last words, and training counts."""

    def __init__(self, of: np.ndarray, keys: np.ndarray, own: np.ndarray, first: np.ndarray, last: np.ndarray, word: np.ndarray):
        self.of, self.keys, self.own = of, keys, own
        self.first, self.last, self.word = first, last, word
        self.total = own  # once answers are in, the counts of all training texts
        self.shared = np.zeros(len(own), bool)  # whether another block has the k-gram


class Block:
    """A block's documents, tokens and n-grams of up to ``order`` words."""

    def __init__(self, row: dict, order: int):
        self.name, self.docs, self.outs = row["block"], row["doc_ids"], row["outs"]
        self.n = np.asarray(row["n_tokens"], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.tok = tok = _unsqueeze(row["tokens"], "<i4")
        self.train = train = np.repeat(~np.asarray(self.outs, bool), self.n)
        h = np.frombuffer(row["words"], np.uint64)
        none = np.empty(0, np.int32)
        self.grams = [None, Grams(tok, h, np.bincount(tok[train], minlength=len(h)), none, none, np.arange(len(h), dtype=np.int32))]
        for k in range(2, order + 1):
            low = self.grams[-1]
            at = np.nonzero((low.of[:-1] != NO) & (tok[:-1] != 0))[0].astype(np.int32) + 1  # nothing follows an end token
            pairs, of = np.unique((low.of[at - 1].astype(np.int64) << 32) | tok[at], return_inverse=True)
            of, first, word = of.astype(np.int32), (pairs >> 32).astype(np.int32), (pairs & LOW).astype(np.int32)
            del pairs
            n = len(first)
            last = np.empty(n, np.int32)
            last[of] = low.of[at]
            with np.errstate(over="ignore"):
                keys = scramble(low.keys[first] * np.uint64(0x9E3779B97F4A7C15) + h[word])
            here = np.full(len(tok), NO)
            here[at] = of
            self.grams.append(Grams(here, keys, np.bincount(of[train[at]], minlength=n), first, last, word))

    def asked(self, k: int) -> np.ndarray:
        """The k-grams whose counts other blocks may add to."""
        g, low = self.grams[k], self.grams[k - 1]
        return np.arange(len(g.own)) if k < 3 else np.nonzero(low.shared[g.first] & low.shared[g.last])[0]

    def messages(self, k: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, its k-grams in the order of their hashes), for each bucket that has any."""
        at = self.asked(k)
        keys = self.grams[k].keys[at]
        order = np.argsort(keys)
        bucket = ((keys[order] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        names, cut = np.unique(bucket, return_index=True)
        for b, part in zip(names.tolist(), np.split(at[order], cut[1:])):
            yield b, part

    def requests(self, k: int, buckets: int) -> list[tuple]:
        g = self.grams[k]
        return [(k, b, self.name, _squeeze(np.diff(g.keys[at], prepend=np.uint64(0))), _squeeze(g.own[at].astype("<u4")), None) for b, at in self.messages(k, buckets)]

    def learn(self, told: dict[tuple[int, int], tuple[bytes, bytes]], buckets: int, order: int) -> None:
        """Take the answers for k-grams of up to ``order`` words."""
        for k in range(1, order + 1):
            g = self.grams[k]
            g.total = g.own.copy()
            for b, at in self.messages(k, buckets):
                if (k, b) in told:
                    bits, counts = told[k, b]
                    have = at[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)]
                    g.shared[have] = True
                    g.total[have] = _unsqueeze(counts, "<i8")

    def left_out(self, k: int, total: int, distinct: int, priors: list[float]) -> list[float]:
        """For each value of GRID as the prior weight of contexts of k - 1 words: the log-likelihood of
        the block's training k-grams, each occurrence being left out of the counts that judge it."""
        less = lambda c: np.maximum(c - 1, 0)
        p = (less(self.grams[1].total) + ADD) / (total - 1 + ADD * (distinct + 1))
        for j in range(2, k + 1):
            g, c = self.grams[j], less(self.grams[j - 1].total)
            p, c, n = p[g.last], c[g.first], less(g.total)
            if j < k:
                p = (n + priors[j - 2] * p) / (c + priors[j - 2])
        use = np.nonzero(self.grams[k].own)[0].astype(np.int32)
        w, n, c, p = self.grams[k].own[use], n[use], c[use], p[use]
        return [float((w * np.log10((n + m * p) / (c + m))).sum()) for m in GRID]


class Automaton:
    """The states, arcs and failure arcs that a block's texts can reach.

    A state of k words is a k-gram seen in training; state 0 words long is the root. ``arcs[k]`` has the
    weight of each k-gram as an arc from its first k - 1 words, for those seen; ``fail[k]`` that of the
    failure arc of each state of k words. The longest contexts' arcs depend on ``m``, the rest do not."""

    def __init__(self, block: Block, order: int, total: int, distinct: int, priors: list[float]):
        self.block, self.order = block, order
        p = (block.grams[1].total + ADD) / (total + ADD * (distinct + 1))
        self.p, self.arcs, self.fail = [None, p], [None, np.log10(p)], [None]
        for k in range(2, order):
            arcs, fail = self.level(k, priors[k - 2])
            self.arcs.append(arcs)
            self.fail.append(fail)
            self.p.append(10.0**arcs)

    def level(self, k: int, m: float) -> tuple[np.ndarray, np.ndarray]:
        """The arcs from states of k - 1 words, and those states' failure arcs, for a prior weight."""
        g, c = self.block.grams[k], self.block.grams[k - 1].total
        return np.log10((g.total + m * self.p[k - 1][g.last]) / (c[g.first] + m)), np.log10(m / (c + m))

    def states(self) -> np.ndarray:
        """The number of words of the state in which each token is read: left to right, a token leads
        to the longest suffix of what was read that training has."""
        size = np.zeros(len(self.block.tok), np.int8)
        for k in range(1, self.order):
            g = self.block.grams[k]
            seen = (g.of[:-1] != NO) & (g.total[g.of[:-1]] > 0) & (self.block.tok[:-1] != 0)
            size[1:][seen] = k
        return size

    def read(self, size: np.ndarray, longest: int) -> np.ndarray:
        """Log10 probability of each token, read from the state of at most ``longest`` words: an arc if
        there is one, else failure arcs down to a state that has it. All texts' steps are taken at once."""
        out, size = np.zeros(len(size)), np.minimum(size, longest)
        for k in range(longest, -1, -1):
            at = np.nonzero(size == k)[0]
            g = self.block.grams[k + 1].of[at]
            hit = self.block.grams[k + 1].total[g] > 0 if k else np.ones(len(at), bool)
            out[at[hit]] += self.arcs[k + 1][g[hit]]
            if k:
                miss = at[~hit]
                out[miss] += self.fail[k][self.block.grams[k].of[miss - 1]]
                size[miss] = k - 1
        return out

    def scores(self, grid: tuple[float, ...]) -> list[np.ndarray]:
        """The texts' log10 probabilities for each prior weight of the longest contexts."""
        size, n = self.states(), self.order - 1
        if n == 0:
            return [np.add.reduceat(self.read(size, 0), self.block.start)] * len(grid)
        down = self.read(size, n - 1)
        at = np.nonzero(size == n)[0]
        g = self.block.grams[n + 1].of[at]
        hit = self.block.grams[n + 1].total[g] > 0
        state = self.block.grams[n].of[at - 1]
        out = []
        for m in grid:
            arcs, fail = self.level(self.order, m)
            each = down.copy()
            each[at] = np.where(hit, arcs[g], fail[state] + down[at])
            out.append(np.add.reduceat(each, self.block.start))
        return out


def answers(asked: DataFrame, parts: int) -> DataFrame:
    """What buckets tell blocks; n_distinct: the bucket's keys with a count, in one of its rows."""

    def add(key, t):
        keys = [np.cumsum(_unsqueeze(x.as_py(), "<u8")) for x in t["keys"]]
        cut = np.cumsum([len(k) for k in keys])[:-1]
        _, at, often = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        own = np.concatenate([_unsqueeze(x.as_py(), "<u4") for x in t["counts"]])
        sums = np.bincount(at, own).astype(np.int64)
        n, rows = int((sums > 0).sum()), []
        for block, g in zip(t["block"], np.split(at, cut)):
            shared = often[g] > 1
            if n or shared.any():
                rows.append((key[0].as_py(), key[1].as_py(), block.as_py(), np.packbits(shared).tobytes(), _squeeze(sums[g[shared]].astype("<i8")), n))
            n = 0
        return _arrow(rows, ANSWER)

    return asked.repartition(parts, "level", "bucket").groupBy("level", "bucket").applyInArrow(add, ANSWER)


def _with_blocks(blocks: DataFrame, told: DataFrame, parts: int, work, schema: str) -> DataFrame:
    """``work(row of a block, its answers)`` for each block, which is as much as a task holds at once."""

    def run(left, right):
        told = {(a, b): (c, d) for a, b, c, d in zip(*(right[c].to_pylist() for c in ("level", "bucket", "shared", "counts")))}
        return pa.concat_tables([_arrow(work(row, told), schema) for row in left.to_pylist()])

    both = (df.repartition(parts, "block").groupBy("block") for df in (blocks, told.select("block", "level", "bucket", "shared", "counts")))
    return next(both).cogroup(next(both)).applyInArrow(run, schema)


def _best(fits: DataFrame) -> int:
    """The index of the highest sum of ``fit``, the first of equal ones."""
    sums = fits.where("fit is not null").select(F.posexplode("fit")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    return max(sums, key=lambda r: (r["s"], -r["pos"]))["pos"] if sums else 0


def score(docs: DataFrame, order: int = 3, m: tuple[float, ...] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document. ``m``:
    the prior weights of contexts of 1, 2, ... words, instead of fitted ones."""
    blocks = stored(blocks_of(docs), "lm-blocks")
    per = F.aggregate(F.arrays_zip("outs", "n_tokens"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["outs"], 0).otherwise(x["n_tokens"]))
    every = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    n_blocks, size, total = blocks.agg(F.count("*"), F.coalesce(F.sum(every), F.lit(0)), F.coalesce(F.sum(per), F.lit(0))).first()
    buckets, parts = max(1, -(-size // BUCKET_TOKENS)), max(1, n_blocks)

    def first_requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch.slice(i, 1).to_pylist()[0], min(order, 2))
                yield from _arrow([r for k in range(1, min(order, 2) + 1) for r in b.requests(k, buckets)], REQUEST).to_batches()

    told = stored(answers(blocks.mapInArrow(first_requests, REQUEST), 2 * buckets), "lm-answers")
    distinct = told.where("level = 1").agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]
    priors: list[float] = []
    for level in range(3, order + 1):

        def more(row, told, level=level, priors=tuple(priors)):
            b = Block(row, level)
            b.learn(told, buckets, level - 1)
            return [*b.requests(level, buckets), (-1, 0, b.name, None, None, b.left_out(level - 1, total, distinct, list(priors)))]

        asked = stored(_with_blocks(blocks, told, parts, more, REQUEST), "lm-requests")
        priors.append(GRID[_best(asked)] if m is None else m[level - 3])
        told = told.unionByName(stored(answers(asked.where("level > 0"), 2 * buckets), "lm-answers"))
        released(asked)
    grid = GRID if m is None else (m[order - 2],) if order > 1 else (1.0,)

    def last(row, told, priors=tuple(priors)):
        b = Block(row, order)
        b.learn(told, buckets, order)
        auto = Automaton(b, order, total, distinct, list(priors))
        base = np.add.reduceat(np.log10(auto.p[1])[b.tok], b.start).tolist()
        known = np.add.reduceat((b.grams[1].total[b.tok] > 0).astype(np.int64), b.start).tolist()
        scores = np.stack(auto.scores(grid), 1).tolist()
        fit = b.left_out(order, total, distinct, list(priors)) if m is None and order > 1 else None
        return [*zip(b.docs, b.outs, b.n.tolist(), known, base, scores, [None] * len(b.docs)), (None, None, None, None, None, None, fit)]

    rows = stored(_with_blocks(blocks, told, parts, last, SCORE), "lm-scores")
    released(blocks)
    best = _best(rows) if m is None else 0
    return rows.where("scores is not null").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"))
