"""Word shingles as 64-bit numbers, and MinHash band keys, in numpy."""

from __future__ import annotations

import math

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    """Numbers its keys in the order they are first asked for; lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Words:
    """Keeps words' 64-bit hashes, the same in every process. Starts anew once it holds ``most``
    words, so memory stays bounded; results don't depend on that."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.ids, self.hashes = _Numbers(), np.empty(1 << 16, np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """The words' hashes, in order."""
        ids = self.ids
        if len(ids) > self.most:
            ids.clear()
        at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        if ids.new:
            n = len(ids)
            if n > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.empty(max(n, len(self.hashes)), np.uint64)])
            self.hashes[n - len(ids.new) : n] = np.fromiter(map(xxhash.xxh3_64_intdigest, ids.new), np.uint64, len(ids.new))
            ids.new.clear()
        return self.hashes[at]


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all n-word shingles. A text of 1 to n-1 words is one shingle
    (of its length); a text without words has none."""
    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    k = min(n, len(hashes))
    with np.errstate(over="ignore"):
        h = np.full(len(hashes) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * _MUL + hashes[i : len(hashes) - k + 1 + i]
        return np.unique(mix(h))


def bands_for(threshold: float, recall: float, false: float = 0.2, most_rows: int = 16) -> tuple[int, int]:
    """(bands, rows): the fewest rows a band, with as many bands as give a pair of just ``threshold``
    similarity the chance ``recall`` to meet, for which a pair of half that similarity meets with a
    chance of at most ``false``."""
    for r in range(1, most_rows + 1):
        p = threshold**r
        b = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))
        if 1 - (1 - (threshold / 2) ** r) ** b <= false:
            break
    return b, r


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        k = bands * rows
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mul = (rng.integers(0, 2**63, k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.add = rng.integers(0, 2**63, k, dtype=np.uint64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """A band key (signed 64-bit; it includes the band's number) for each band."""
        low = np.full(len(self.mul), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(s), 1024):
                x = s[None, i : i + 1024] * self.mul[:, None]
                x += self.add[:, None]
                np.minimum(low, x.min(axis=1), out=low)
            low = low.reshape(self.bands, self.rows)
            h = np.arange(1, self.bands + 1, dtype=np.uint64)
            for j in range(self.rows):
                h = mix(h * _MUL + low[:, j])
        return h.view(np.int64)
