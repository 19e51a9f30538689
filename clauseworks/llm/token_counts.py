"""Operator 1, token counts: heap-and-linked-list byte-pair merging without identifiers."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm._streams import small_batches
from clauseworks.llm.pretoken import merges, splitter

#: Words whose counts a Python worker remembers; it then starts afresh. Bounds memory, not results.
REMEMBERED = 400_000


def count_word(word: bytes, pairs: dict[int, tuple[int, int]]) -> int:
    """Symbols left of one word after all merges: the initial symbols minus the merges made.

    A heap holds the adjacent pairs by (rank, position); the symbols form a linked list. An entry
    whose pair has changed since is skipped when popped.
    """
    n = len(word)
    if n < 2:
        return n
    symbols = list(word)
    get = pairs.get
    heap = []
    for i in range(n - 1):
        hit = get(symbols[i] << 20 | symbols[i + 1])
        if hit:
            heap.append((hit[0], i, hit[1]))
    if not heap:
        return n
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    left = n
    while heap:
        rank, i, merged = heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= n:
            continue
        hit = get(symbols[i] << 20 | symbols[j])
        if hit is None or hit[0] != rank:
            continue
        symbols[i], symbols[j] = merged, -1
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            hit = get(merged << 20 | symbols[k])
            if hit:
                heappush(heap, (hit[0], i, hit[1]))
        h = before[i]
        if h >= 0:
            hit = get(symbols[h] << 20 | merged)
            if hit:
                heappush(heap, (hit[0], h, hit[1]))
    return left


class Counter(dict):
    """word -> its number of tokens, computed when first asked for."""

    def __init__(self, path: str):
        self.pairs, self.special = merges(path)

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = count_word(word.encode("utf-8", "surrogatepass"), self.pairs)
        return n


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each Python worker and vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_text(text: str, words: Counter, find, special) -> int:
    """Special strings count one token each and split the text, as the library's default has it."""
    total = 0
    if special and any(s in text for s in words.special):
        parts = special.split(text)
        total = len(parts) - 1
    else:
        parts = (text,)
    get = words.__getitem__
    for part in parts:
        total += sum(map(get, find(part)))
    return total


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", limit: int = 512) -> DataFrame:
    """docs' columns plus n_bytes, n_tokens (longs) and over_limit (n_tokens > limit).

    vocabulary is the path of a byte-level tokenizers .json on every node. A null or empty text has
    0 bytes and 0 tokens. Columns of docs with these three names are replaced. Rows keep their
    multiplicity; ties and copies are counted alike. One narrow stage: no shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = counter(vocabulary)
        find = splitter(pattern).findall
        special = regex.compile("|".join(map(regex.escape, words.special))) if words.special else None
        for batch in batches:
            texts = batch.to_pylist()
            yield pa.array([count_text(t, words, find, special) if t else 0 for t in texts], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    counted = F.arrow_udf(run, returnType="long")
    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")))
        .withColumn("n_tokens", counted(F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents under byte_bpe_50k.json."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).select("doc_id", "n_bytes", "n_tokens", "over_limit")
