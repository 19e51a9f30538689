"""Operator 5, benchmark decontamination: SimHash of item-sized windows, found by Hamming blocks.

A document's windows have the number of words of some benchmark item. A window can't be similar to
an item if it has fewer shingles of the benchmark than hold the threshold's share of the item's weight,
so only windows with as many are fingerprinted (no window that verifies is left out). Their
64-bit SimHashes are looked up in four 16-bit blocks: if two fingerprints differ in at most RADIUS
bits, one block differs in at most a quarter of that, and all such values of a block are listed.
Candidates are then verified by the exact weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm._streams import small_batches
from clauseworks.llm.shingles import mix, windows

WORDS_IN_SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 19
#: Items (and their characters) that are broadcast at once; a larger benchmark takes more passes over the documents.
SLICE_ITEMS, SLICE_CHARS = 1000, 2_000_000
#: Words of a stretch of text that is fingerprinted at once.
STRETCH = 20_000


class Letters(dict):
    """word -> 64-bit hash of its letters and digits, 0 if it has none; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        plain = word.strip(".,;:!?|\"'()")
        if not plain.isalnum():
            plain = "".join(filter(str.isalnum, plain))
        h = self[word] = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) | 1 if plain else 0
        return h


LETTERS = Letters()


def word_hashes(text: str | None) -> np.ndarray:
    """Of the lower-cased words between white space, less all but their letters and digits."""
    words = text.lower().split() if text else []
    h = np.fromiter(map(LETTERS.__getitem__, words), np.uint64, len(words))
    return h if h.all() else h[h != 0]


def bit_sums(h: np.ndarray) -> np.ndarray:
    """Running sums, from zero, of each word's 64 signs."""
    bits = np.unpackbits(mix(h ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int32) * 2 - 1, axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHashes of the windows of `length` words at starts."""
    up = (sums[starts + length] - sums[starts]) > 0
    return np.packbits(up, axis=1, bitorder="little").view(np.uint64).reshape(-1)


class Index:
    """A slice of the benchmark: its shingles, and its fingerprints by block. Only the items travel to the executors.

    Weights are those of the whole benchmark: whole has its number of items with words, and the shingles
    of several items with the number of those (all others weigh the same). Without it, the slice is all.
    """

    def __init__(self, items: list[tuple[int, str]], radius: int, threshold: float, n: int, whole: tuple[int, np.ndarray, np.ndarray] | None = None):
        self.items, self.radius, self.threshold, self.n, self.whole = items, radius, threshold, n, whole

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("items", "radius", "threshold", "n", "whole")}

    @cached_property
    def built(self) -> Index:
        words = [word_hashes(t) for _, t in self.items]
        known = [i for i, w in enumerate(words) if len(w)]
        self.ids = [self.items[i][0] for i in known]
        words = [words[i] for i in known]
        self.length = np.array([len(w) for w in words], np.int64)
        self.shingles = [Counter(windows(w, self.n).tolist()) for w in words]
        df = Counter(h for s in self.shingles for h in s) if self.whole is None else {}
        several = {h: k for h, k in df.items() if k > 1}
        count, common, k = self.whole or (len(words), np.array(list(several), np.uint64), np.array(list(several.values()), np.int64))
        order = np.argsort(common)
        self.common = common[order]
        self.common_weight = np.array([math.log(1 + count / x) for x in k[order].tolist()])
        self.rare = math.log(1 + count)
        self.own, self.least = [], {}
        for size, c in zip(self.length.tolist(), self.shingles, strict=True):
            weight = np.sort(np.repeat(self.weights(np.array(list(c), np.uint64)), list(c.values())))[::-1].cumsum()
            self.own.append(float(weight[-1]))
            # the fewest of the item's shingles that make up the threshold's share of its weight
            few = int(np.searchsorted(weight, self.threshold * weight[-1] - 1e-9)) + 1
            self.least[size] = min(self.least.get(size, few), few)
        self.sizes = sorted(set(self.length.tolist()))
        self.widths = sorted({min(self.n, size) for size in self.sizes})
        self.marks = {}
        for width in self.widths:
            s = np.unique(np.array([h for w, c in zip(words, self.shingles, strict=True) if min(self.n, len(w)) == width for h in c], np.uint64))
            mask = np.zeros(1 << 20, bool)
            mask[(s >> np.uint64(44)).astype(np.int64)] = True
            self.marks[width] = (mask, s)
        fp = np.array([fingerprints(bit_sums(w), np.zeros(1, np.int64), len(w))[0] for w in words], np.uint64)
        self.fp = fp
        near = [sum(1 << b for b in some) for k in range(self.radius // 4 + 1) for some in combinations(range(16), k)]
        flips = np.array(near, np.uint16)
        self.blocks = []
        for b in range(4):
            part = ((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            values = (part[:, None] ^ flips).reshape(-1)
            order = np.argsort(values, kind="stable")
            owners = np.repeat(np.arange(len(fp), dtype=np.int32), len(flips))[order]
            self.blocks.append((np.searchsorted(values[order], np.arange(65537)), owners))
        return self

    def candidates(self, fp: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """(window, item) for items of this size within the radius."""
        found = set()
        for b, (at, owners) in enumerate(self.blocks):
            part = ((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            begin, end = at[part], at[part + 1]
            n = end - begin
            w = np.repeat(np.arange(len(fp)), n)
            item = owners[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            right = self.length[item] == size
            w, item = w[right], item[right]
            right = np.bitwise_count(fp[w] ^ self.fp[item]) <= self.radius
            found.update(zip(w[right].tolist(), item[right].tolist(), strict=True))
        yield from sorted(found, key=lambda x: (x[1], x[0]))

    def weights(self, s: np.ndarray) -> np.ndarray:
        """Of each shingle: ln(1 + items / items that have it), or as if one item had it if none has."""
        if not len(self.common):
            return np.full(len(s), self.rare)
        at = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
        return np.where(self.common[at] == s, self.common_weight[at], self.rare)

    def bounds(self, s: np.ndarray, item: int) -> np.ndarray:
        """Running sums over s, from zero: weights of all shingles, and of those that the item has."""
        out = np.zeros((2, len(s) + 1))
        all_of = self.weights(s).tolist()
        its = self.shingles[item]
        out[0, 1:] = np.cumsum(all_of)
        out[1, 1:] = np.cumsum([w if h in its else 0.0 for w, h in zip(all_of, s.tolist(), strict=True)])
        return out

    def similarity(self, window: list[int], item: int) -> float:
        mine, its = Counter(window), self.shingles[item]
        least = most = 0.0
        both = list(mine.keys() | its.keys())
        for h, w in zip(both, self.weights(np.array(both, np.uint64)).tolist(), strict=True):
            a, b = mine[h], its[h]
            least += w * min(a, b)
            most += w * max(a, b)
        return least / most if most else 0.0

    def leaks(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of its best window, the first of equals."""
        h = word_hashes(text)
        best: dict[int, tuple[float, int, int]] = {}
        for width in self.widths:
            if len(h) < width:
                continue
            s = windows(h, width)
            mask, exact = self.marks[width]
            hits = np.flatnonzero(mask[(s >> np.uint64(44)).astype(np.int64)])
            hits = hits[exact[np.minimum(np.searchsorted(exact, s[hits]), len(exact) - 1)] == s[hits]]
            sizes = [x for x in self.sizes if min(self.n, x) == width and x <= len(h)]
            if not len(hits) or not sizes:
                continue
            far = max(sizes)
            cuts = np.flatnonzero(np.diff(hits) > 2 * far) + 1
            for some in np.split(hits, cuts):
                for i in range(int(some[0]), int(some[-1]) + 1, STRETCH):
                    part = some[(some >= i) & (some < i + STRETCH)]
                    if len(part):
                        self._stretch(h, s, some, int(part[0]), int(part[-1]), width, sizes, best)
        return best

    def _stretch(self, h: np.ndarray, s: np.ndarray, hits: np.ndarray, first: int, last: int, width: int, sizes: list[int], best: dict) -> None:
        low, high = max(0, first - max(sizes)), min(len(h), last + width + max(sizes))
        seen = np.zeros(high - low - width + 2, np.int32)
        seen[hits[(hits >= low) & (hits <= high - width)] - low + 1] = 1
        seen = seen.cumsum()
        sums = None
        for size in sizes:
            n = high - low - size + 1
            starts = np.flatnonzero(seen[size - width + 1 :] - seen[:n] >= self.least[size]) if n > 0 else ()
            if not len(starts):
                continue
            sums = bit_sums(h[low:high]) if sums is None else sums
            before = None
            for w, item in self.candidates(fingerprints(sums, starts, size), size):
                if item != before:  # what a window shares with the item is no more than its weight of the item's shingles
                    before, run, own = item, self.bounds(s[low : high - width + 1], item), self.own[item]
                at = low + int(starts[w])
                weight, shared = run[:, at - low + size - width + 1] - run[:, at - low]
                if shared < (self.threshold - 1e-9) * (weight + own - shared):
                    continue
                found = self.similarity(s[at : at + size - width + 1].tolist(), item)
                if found >= self.threshold - 1e-12:
                    old = best.get(item)
                    if old is None or (-found, at) < (-old[0], old[1]):
                        best[item] = (found, at, size)


def whole_counts(given: DataFrame, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many items (i, t) have words, the n-word shingles that several of them have, and how many have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                own = np.unique(windows(word_hashes(t), n))
                if len(own):  # the row of null counts the item
                    yield pa.RecordBatch.from_arrays([pa.array([None, *own.view(np.int64).tolist()], pa.int64())], names=["h"])

    counts = given.select("t").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("k")).where("h is null or k > 1").toArrow()
    h, k = counts.column("h"), counts.column("k").to_numpy()
    known = h.is_valid().to_numpy()
    return int(k[~known].sum()), h.drop_null().to_numpy().astype(np.int64).view(np.uint64), k[known]


def find_leaks(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, n: int = WORDS_IN_SHINGLE) -> DataFrame:
    """(id, item_id, similarity, first_word, n_words): each item that a document holds, with its best window.

    Words are what stands between white space, lower-cased and less all but letters and digits; a window of an item's number of words holds
    the item if their multisets of n-word shingles, weighted by ln(1 + items / items that have the
    shingle), have a Jaccard similarity of threshold or more and their SimHashes differ in at most
    radius bits. Null, empty and wordless texts and items match nothing; an item shorter than n
    words is one shingle. Equal windows: the first counts. Repeated documents are looked at one by
    one, repeated items likewise. No shuffle: the benchmark is broadcast in slices of SLICE_ITEMS
    items and about SLICE_CHARS characters; a larger one takes a pass over docs for each slice. Each
    slice takes along the counts of all shingles that several items have, 16 bytes for each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    count, chars = given.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    slices = max(1, math.ceil(count / SLICE_ITEMS), math.ceil(chars / SLICE_CHARS))
    rows = docs.select(F.col(ident).cast("long").alias(ident), F.col(text).alias("t"))
    schema = f"`{ident}` long, `{item}` long, similarity double, first_word int, n_words int"
    whole = whole_counts(given, n) if slices > 1 else None
    out = None
    for k in range(slices):
        some = given.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k).orderBy("i", "t").collect()
        shared = spark.sparkContext.broadcast(Index([(r.i, r.t) for r in some], radius, threshold, n, whole))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value.built
            for b in batches:
                found = []
                for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found += [(doc, index.ids[i], *x) for i, x in sorted(index.leaks(t).items())] if index.ids else []
                if found:
                    columns = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=[ident, item, "similarity", "first_word", "n_words"])
            LETTERS.clear()  # a worker goes on to other operators

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold; documents without any have no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("similarity", F.round("similarity", 9))
