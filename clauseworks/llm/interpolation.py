"""Operator 7, LM scoring by deleted interpolation of word n-grams.

The probability of a word after another is a mixture of maximum-likelihood bigram and unigram
estimates and a uniform one. The weights depend on how often the context was seen and are learned
by expectation-maximisation on held-out training documents (a tenth of all), against counts from
the other training documents; the final estimates count all training documents.

Documents are first packed into chunks: word hashes of the chunk, and its text as numbers of them.
A chunk asks for the corpus counts of its distinct words and word pairs: sorted hashes, delta-coded,
one slice for each bucket of the hash space that it has entries in. A bucket adds up what all chunks
sent and answers each in its own order. So a word's occurrences never meet in one task; the number
of buckets follows the number of distinct entries, and no count table is collected or broadcast.
Every chunk asks for a common word, so chunks are dealt to sets of bounded size: a set's slices of a
bucket are added up first, the bucket answers the sets, and each set answers its chunks.
Slices hold at least one entry, so their number never exceeds that of the chunks' distinct entries,
which grows in proportion to the text; where buckets get many, slices get shorter, not more.

Words and pairs are told apart by 64-bit hashes: of n distinct ones, about n / 2^64 share a hash with
another, and their counts are then added together (for 10^13 pairs, one in two million).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm._streams import per_group, small_batches
from clauseworks.llm.shingles import mix
from clauseworks.runtime import materialize

#: Tokens of a chunk, and entries of a bucket.
CHUNK_TOKENS, BUCKET_ENTRIES = 500_000, 1_500_000
#: Chunks of a set, whose slices of one bucket meet in a task: fewer than the entries that a bucket has on average.
SET_CHUNKS = 262_144
#: Of crc32(id as text) mod 10: 0 is never learned from, 9 is held out for the mixture weights.
UNSEEN, MIXING = 0, 9
#: Context-frequency buckets (counts below EXACT one by one, then by powers of two), bins of a nat and number of bins of the
#: held-out histogram, rounds.
EXACT, CONTEXTS, PER_NAT, BINS, ROUNDS = 8, 24, 4, 120, 60

END = np.uint64(xxhash.xxh64_intdigest(b"\n end"))
BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\n begin"))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


WORDS = Words()


def token_hashes(text: str | None) -> np.ndarray:
    """Words between white space with A-Z lower-cased, then one end."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    width = 4 if numbers.dtype.itemsize <= 4 else 8
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + len(numbers).to_bytes(8, "little") + (pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(numbers) else b"")


def unpack(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    if not n:
        return np.zeros(0, f"<u{width}")
    planes = np.frombuffer(pa.decompress(blob[9:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1)


def pack_sorted(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def remainder(ident: Column) -> Column:
    """crc32 of the id as text, mod 10; of a null id that of documents never learned from."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 10, F.lit(UNSEEN)).cast("int")


def chunks_of(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(chunk, mixing, docs, has_id, part, lengths, vocabulary, ids, n_words, n_pairs).

    A chunk holds documents for the mixture weights only, or others only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[int | None, int, np.ndarray]]] = {True: [], False: []}
        size = {True: 0, False: 0}
        made = 0

        def emit(mixing: bool) -> pa.RecordBatch:
            nonlocal made
            rows, held[mixing], size[mixing] = held[mixing], [], 0
            h = np.concatenate([r[2] for r in rows])
            lengths = np.array([len(r[2]) for r in rows], np.uint32)
            words, ids = np.unique(h, return_inverse=True)
            chunk = (TaskContext.get().partitionId() << 32) | made
            made += 1
            values = [chunk, mixing, np.array([r[0] or 0 for r in rows], np.int64).tobytes(), bytes(r[0] is not None for r in rows), bytes(r[1] for r in rows), pack(lengths), pack_sorted(words), pack(ids.astype(np.uint32)), len(words), len(h)]
            kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
            names = ["chunk", "mixing", "docs", "has_id", "part", "lengths", "vocabulary", "ids", "n_words", "n_pairs"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for b in batches:
            for doc, part, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h = token_hashes(t)
                mixing = part == MIXING
                if held[mixing] and size[mixing] + len(h) > CHUNK_TOKENS:
                    yield emit(mixing)
                held[mixing].append((doc, part, h))
                size[mixing] += len(h)
        for mixing in (False, True):
            if held[mixing]:
                yield emit(mixing)

    given = docs.select(F.col(ident).cast("long").alias("id"), remainder(F.col(ident)).alias("part"), F.col(text).alias("t"))
    return given.mapInArrow(run, "chunk long, mixing boolean, docs binary, has_id binary, part binary, lengths binary, vocabulary binary, ids binary, n_words long, n_pairs long")


class Chunk:
    """A chunk's tokens: hash of each, number of each, which are learned from, and where documents start."""

    def __init__(self, row: dict):
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = unpack_sorted(row["vocabulary"])
        self.ids = unpack(row["ids"])
        self.part = np.frombuffer(row["part"], np.uint8)
        self.learned = np.repeat(self.part != UNSEEN, self.lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the word pairs, and for each token the number of its pair."""
        h = self.words[self.ids]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.starts] = BEGIN
        return np.unique(mix(mix(before) + h), return_inverse=True)


def _slices(entries: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted 64-bit numbers: equal shares of their range; empty ones are left out."""
    bucket = (entries >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    return list(zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(entries)], strict=True)) if len(entries) else []


def _small(x: np.ndarray) -> bytes:
    return pack(x.astype(np.uint32 if not len(x) or x.max() < 2**32 else np.uint64))


class Slices:
    """Slices of a bucket, added up: distinct entries, their total and retained counts, and where each slice's are."""

    def __init__(self, entries: list[bytes], counts: list[bytes], retained: list[bytes | None]):
        parts = [unpack_sorted(x) for x in entries]
        add = lambda given: np.bincount(self.number, np.concatenate([np.zeros(len(p), np.uint32) if x is None else unpack(x) for p, x in zip(parts, given, strict=True)]), len(self.distinct))
        self.distinct, self.number = np.unique(np.concatenate(parts), return_inverse=True)
        self.total, self.kept = add(counts), add(retained)
        ends = np.cumsum([len(p) for p in parts])
        self.own = [self.number[e - len(p) : e] for p, e in zip(parts, ends.tolist(), strict=True)]


_ANSWERS = "chunk long, bucket int, total binary, retained binary, words long, tokens long, retained_tokens long"


def _answered(name: str, to: list[int], bucket: int, own: list[np.ndarray], total: np.ndarray, kept: np.ndarray, told: list[bool], sums: bool) -> pa.RecordBatch:
    """A row with the counts for each of `to` (retained ones where told), and one with the bucket's own sums."""
    n, last = len(to), [None] * sums
    columns = [
        pa.array([*to, *last], pa.int64()),
        pa.array([bucket] * (n + sums), pa.int32()),
        pa.array([*(_small(total[i]) for i in own), *last], pa.binary()),
        pa.array([*(_small(kept[i]) if m else None for i, m in zip(own, told, strict=True)), *last], pa.binary()),
        *(pa.array([0] * n + [int(x)] * sums, pa.int64()) for x in ((total > 0).sum(), total.sum(), kept.sum())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[name, "bucket", "total", "retained", "words", "tokens", "retained_tokens"])


def answers(chunks: DataFrame, pairs: bool, entries: int, count: int) -> DataFrame:
    """(chunk, bucket, total, retained, words, tokens): corpus counts for each of `count` chunks' entries of a bucket.

    total counts all training documents; retained (only for mixing chunks) those that don't serve
    the mixture weights. A row without chunk holds a bucket's number of distinct entries and tokens
    seen in training, and its retained tokens.
    """
    buckets, sets = max(1, -(-entries // BUCKET_ENTRIES)), max(1, -(-count // SET_CHUNKS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row)
                entry, number = c.pairs() if pairs else (c.words, c.ids)
                counts = np.bincount(number[c.learned], minlength=len(entry)).astype(np.uint32)
                found = _slices(entry, buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in found], pa.int32()), pa.array([row["chunk"]] * len(found), pa.int64()), pa.array([row["mixing"]] * len(found)), pa.array([pack_sorted(entry[i:j]) for _, i, j in found], pa.binary()), pa.array([pack(counts[i:j]) for _, i, j in found], pa.binary())],
                    names=["bucket", "chunk", "mixing", "entries", "counts"],
                )

    def added(t: pa.Table) -> tuple[Slices, list[bool]]:
        mixing, counts = t["mixing"].to_pylist(), t["counts"].to_pylist()
        return Slices(t["entries"].to_pylist(), counts, [None if m else c for c, m in zip(counts, mixing, strict=True)]), mixing

    def answer(t: pa.Table) -> pa.RecordBatch:
        x, mixing = added(t)
        return _answered("chunk", t["chunk"].to_pylist(), t["bucket"][0].as_py(), x.own, x.total, x.kept, mixing, True)

    # the pairs and words are asked for by narrow passes over the chunks; only packed slices are shuffled
    asked = chunks.mapInArrow(ask, "bucket int, chunk long, mixing boolean, entries binary, counts binary")
    if sets == 1:
        return per_group(asked, ["bucket"], answer, _ANSWERS, least=1)

    def set_sums(t: pa.Table) -> pa.RecordBatch:
        x, _ = added(t)
        columns = [t["bucket"][:1].combine_chunks(), t["part"][:1].combine_chunks(), *(pa.array([v], pa.binary()) for v in (pack_sorted(x.distinct), _small(x.total), _small(x.kept)))]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "part", "entries", "counts", "retained"])

    def answer_sets(t: pa.Table) -> pa.RecordBatch:
        x = Slices(*(t[c].to_pylist() for c in ("entries", "counts", "retained")))
        return _answered("part", t["part"].to_pylist(), t["bucket"][0].as_py(), x.own, x.total, x.kept, [True] * len(t), True)

    def answer_chunks(t: pa.Table) -> pa.RecordBatch:
        told = t.filter(pc.is_null(t["chunk"]))
        slices = t.filter(pc.is_valid(t["chunk"]))
        x, mixing = added(slices)
        total, kept = (unpack(told[c][0].as_py()) for c in ("total", "retained"))
        return _answered("chunk", slices["chunk"].to_pylist(), t["bucket"][0].as_py(), x.own, total, kept, mixing, False)

    # asked twice, which costs less than a table of all slices
    asked = asked.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(sets)))
    sums = per_group(asked, ["bucket", "part"], set_sums, "bucket int, part long, entries binary, counts binary, retained binary", least=1)
    by_set = materialize(per_group(sums, ["bucket"], answer_sets, _ANSWERS.replace("chunk", "part"), least=1), "set-counts")
    told = by_set.where("part is not null").select("bucket", "part", "total", "retained")
    both = asked.unionByName(told, allowMissingColumns=True)
    return per_group(both, ["bucket", "part"], answer_chunks, _ANSWERS, least=1).unionByName(by_set.where("part is null").withColumnRenamed("part", "chunk"))


_PACKED = ["docs", "has_id", "part", "lengths", "vocabulary", "ids"]


def _together(chunks: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of each chunk: itself (kind 0) and the answers to its questions for words (1) and pairs (2).

    A union dealt by chunk takes one shuffle and keeps rows small, where joins would nest all answers in one row.
    """
    none = lambda names: [F.lit(None).cast("binary").alias(c) for c in names]
    out = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), *none(["total", "retained"]), *_PACKED)
    for kind, given in ((1, words), (2, pairs)):
        out = out.unionByName(given.where("chunk is not null").select("chunk", F.lit(kind).alias("kind"), "bucket", "total", "retained", *none(_PACKED)))
    return out


def _gathered(t: pa.Table) -> dict:
    """A chunk's rows as one: its own columns, and its answers in order of bucket."""
    kind, bucket = t["kind"].to_numpy(), t["bucket"].to_numpy()
    own = int(np.flatnonzero(kind == 0)[0])
    row = {c: t[c][own].as_py() for c in _PACKED}
    for k, name in ((1, "words_of"), (2, "pairs_of")):
        at = np.flatnonzero(kind == k)
        row[name] = t.take(at[np.argsort(bucket[at])]).select(["total", "retained"])
    return row


def _told(answers: pa.Table, which: str) -> np.ndarray:
    return np.concatenate([unpack(x.as_py()) for x in answers[which]]).astype(np.float64)


def _context(count: np.ndarray) -> np.ndarray:
    """The context-frequency bucket of a count: small counts have one each, larger ones one for each power of two."""
    high = EXACT + np.floor(np.log2(np.maximum(count, EXACT) / EXACT)).astype(np.int64)
    return np.where(count < EXACT, count.astype(np.int64), np.minimum(high, CONTEXTS - 1))


def _estimates(c: Chunk, row: dict, which: str, tokens: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: its count, its context's bucket, and the bigram and unigram estimates."""
    by_word = _told(row["words_of"], which)
    _, number = c.pairs()
    own = by_word[c.ids]
    context = np.empty_like(own)
    context[1:] = own[:-1]
    # every document of the training part has one end and one beginning
    context[c.starts] = by_word[np.searchsorted(c.words, END)]
    pair = _told(row["pairs_of"], which)[number]
    return own, _context(context), np.divide(pair, context, out=np.zeros_like(pair), where=context > 0), own / tokens if tokens else np.zeros_like(own)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for impossible, else by the logarithm."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.minimum(np.floor(-np.log(np.maximum(p, 1e-300)) * PER_NAT), BINS - 2), 0).astype(np.int64)


def mixture(rows: list, uniform: float) -> np.ndarray:
    """Weights (context bucket; bigram, unigram, uniform) by expectation-maximisation on the held-out histogram.

    Each component starts with one token of its own, so no weight is ever zero; a bucket without
    held-out tokens gets the weights of all buckets together.
    """

    def learn(n: np.ndarray, p: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = w * p
            share *= (n / share.sum(1))[:, None]
            w = share.sum(0) + 1
            w /= w.sum()
        return w

    n = np.array([r["n"] for r in rows], np.float64)
    p = np.array([[r["p2"] / r["n"], r["p1"] / r["n"], uniform] for r in rows]).reshape(-1, 3)
    context = np.array([r["context"] for r in rows], np.int64)
    pooled = learn(n, p)
    return np.array([learn(n[context == b], p[context == b]) if (context == b).any() else pooled for b in range(CONTEXTS)])


def score_texts(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words between ASCII white space with A-Z lower-cased, then one end; a null or
    empty text is only an end. base_score is the additive-smoothing unigram score, score the
    mixture's log10 probability; a word never seen in training is one more word of the vocabulary.
    Documents whose remainder is UNSEEN, and those without an id, are scored but not learned from.
    With no training document at all, counts are zero and the score is the uniform estimate's.
    Repeated rows are documents of their own. Extra columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chunks = materialize(chunks_of(docs, ident, text), "chunks")
    small_batches(spark, size=4 << 20)  # rows are whole chunks from here on
    n_words, n_pairs, count = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_pairs"), F.lit(0)), F.count("*")).first()
    words = materialize(answers(chunks, False, n_words, count), "word-counts")
    pairs = materialize(answers(chunks, True, n_pairs, count), "pair-counts")
    v, n, kept = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens", "retained_tokens"))).first()
    uniform = 1 / (v + 1)

    def held_out(t: pa.Table) -> pa.RecordBatch:
        row = _gathered(t)
        _, context, p2, p1 = _estimates(Chunk(row), row, "retained", kept)
        cell, number = np.unique((context * BINS + _bin(p2)) * BINS + _bin(p1), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.bincount(number)), pa.array(np.bincount(number, p2)), pa.array(np.bincount(number, p1))], names=["cell", "n", "p2", "p1"])

    mixing = _together(chunks.where("mixing"), words.where("retained is not null"), pairs.where("retained is not null"))
    sums = per_group(mixing, ["chunk"], held_out, "cell long, n long, p2 double, p1 double", least=1)
    # at most CONTEXTS * BINS * BINS rows, whatever the data
    histogram = sums.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).withColumn("context", F.floor(F.col("cell") / (BINS * BINS))).orderBy("cell").collect()
    weights = mixture(histogram, uniform)

    def scored(t: pa.Table) -> pa.RecordBatch:
        row = _gathered(t)
        c = Chunk(row)
        own, context, p2, p1 = _estimates(c, row, "total", n)
        p2 *= weights[context, 0]
        p1 *= weights[context, 1]
        score = np.log10(p2 + p1 + weights[context, 2] * uniform)
        base = np.log10((own + 0.1) / (n + 0.1 * (v + 1)))
        per = lambda x: np.add.reduceat(x, c.starts)
        has = np.frombuffer(row["has_id"], np.uint8) > 0
        columns = [pa.array(np.frombuffer(row["docs"], np.int64), mask=~has), pa.array(c.part == UNSEEN), pa.array(c.lengths), pa.array(per((own > 0).astype(np.int64))), pa.array(np.full(len(c.lengths), n, np.int64)), pa.array(per(base)), pa.array(per(score))]
        return pa.RecordBatch.from_arrays(columns, names=[ident, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{ident}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return per_group(_together(chunks, words, pairs), ["chunk"], scored, schema, least=1)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and mixture scores of all whole documents."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
