"""Word shingles as 64-bit hashes, and MinHash values of sets of them."""

from __future__ import annotations

import math

import numpy as np
import xxhash

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Words(dict):
    """word -> 64-bit hash, kept for the words met so far (and forgotten when there are too many)."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


WORDS = Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n words in a row; of all words, if there are fewer than n (none for none)."""
    n = min(n, len(h))
    if not n:
        return h
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total = (total + h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return mix(total)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text's lower-cased words."""
    return np.unique(windows(hashes(text.lower().split()), n)) if text else np.zeros(0, np.uint64)


def permutations(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, np.uint64)


def minhash(shingles: np.ndarray, odd: np.ndarray, add: np.ndarray, step: int = 2048) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty, in blocks of bounded size."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), step):
        least = np.minimum(least, (shingles[i : i + step, None] * odd + add).min(0))
    return least


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of `rows` MinHash values that catch a pair at the threshold with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def layout(threshold: float, recall: float, background: float = 0.2, budget: int = 128) -> tuple[int, int]:
    """(bands, rows) for a recall at the threshold: of the layouts within `budget` hash functions, the
    one with the least chance of a collision at the background similarity."""
    found = [(bands_for(threshold, recall, r), r) for r in range(1, 17)]
    fitting = [(b, r) for b, r in found if b * r <= budget] or [min(found, key=lambda x: x[0] * x[1])]
    return min(fitting, key=lambda x: 1 - (1 - background ** x[1]) ** x[0])
