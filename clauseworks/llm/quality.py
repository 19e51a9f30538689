"""Operator 4, quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, hashed to a fixed number of terms, and its shape: pairs of character
classes at one and two steps, and words that do or don't repeat the word before. Both kinds are
weighted by tf-idf and count alike. The singular vectors of a bounded sample of labelled texts span
the latent space. The sample's vectors are broadcast; every text is compared with all of them by
exact cosine products in blocks, and the nearest labels vote by their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clauseworks.llm._streams import bytes_of, small_batches

#: Labelled texts that a model may hold of each label: the documented bound of the sample.
SAMPLE_PER_LABEL = 1500
#: Dimensions of the latent space, neighbours that vote, and the power that similarity is raised to.
DIMENSIONS, NEIGHBOURS, SHARPNESS = 60, 15, 4
THRESHOLD = 0.3

CLASSES = 32


def _classes() -> np.ndarray:
    """byte -> character class: letters by case and vowel, digits, white space, common marks, parts of longer characters."""
    table = np.full(256, 31, np.uint8)
    for group, members in enumerate([b" ", b"\n\r", b"\t\x0b\x0c", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b".", b",", b"!", b"?", b"|", b"&", b"$%", b"#", b"*", b"'\"`", b"-_", b"()[]{}", b"<>", b":;", b"/\\", b"@", b"=+~^"]):
        table[list(members)] = group
    table[0x80:0xC0] = 25
    table[0xC0:0xE0] = 26
    table[0xE0:0x100] = 27
    return table


_CLASS = _classes()
#: A word counts as much as so many pairs of characters.
WORD = 12
SHAPE_TERMS, WORD_TERMS = 2 * CLASSES * CLASSES + 2, 4096
TERMS = SHAPE_TERMS + WORD_TERMS


class Terms(dict):
    """word -> its term, kept for the words met so far (and forgotten when there are too many)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word) % WORD_TERMS
        return h


_TERMS = Terms()


def counts(raw: memoryview | bytes) -> np.ndarray:
    """Of one whole text: how often each pair of classes occurs at one and at two steps, words that repeat the last one or don't, and each word's term (A-Z lower-cased)."""
    c = _CLASS[np.frombuffer(raw, np.uint8)].astype(np.int32)
    out = np.zeros(TERMS, np.float32)
    if len(c) > 1:
        out[: CLASSES * CLASSES] = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    if len(c) > 2:
        out[CLASSES * CLASSES : SHAPE_TERMS - 2] = np.bincount(c[:-2] * CLASSES + c[2:], minlength=CLASSES * CLASSES)
    words = bytes(raw).split()
    same = sum(map(eq, words, words[1:]))
    out[SHAPE_TERMS - 2 : SHAPE_TERMS] = WORD * same, WORD * max(len(words) - 1 - same, 0)
    terms = np.fromiter(map(_TERMS.__getitem__, bytes(raw).lower().split()), np.int64, len(words))
    out[SHAPE_TERMS:] = np.bincount(terms, minlength=WORD_TERMS)
    return out


def _weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies, by idf, at unit length for the shape and for the words (zero rows stay zero)."""
    out = np.empty(tf.shape, np.float32)
    for part in (slice(0, SHAPE_TERMS), slice(SHAPE_TERMS, TERMS)):
        w = np.sqrt(tf[:, part] / np.maximum(tf[:, part].sum(1, keepdims=True), 1)) * idf[part]
        out[:, part] = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
    return out


def _leading(gram: np.ndarray, most: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (not near zero) of a symmetric matrix and their vectors: orthogonal iteration on twice as many columns.

    A whole decomposition would take ten times the matrix's memory.
    """
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((len(gram), min(2 * most, len(gram)))).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(gram @ q)[0]
    power, turn = np.linalg.eigh(q.T @ gram @ q)
    some = np.flatnonzero(power > max(power[-1], 0) * 1e-6)[-most:][::-1]
    return power[some], q @ turn[:, some]


def _latent(weighed: np.ndarray, basis: np.ndarray) -> np.ndarray:
    v = weighed @ basis
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, tf: np.ndarray) -> np.ndarray:
        return _latent(_weigh(tf, self.idf), self.basis)

    def score(self, tf: np.ndarray, block: int = 512) -> np.ndarray:
        """The share of label 1 in the votes of the nearest labelled texts; 0.5 where there are none.

        Texts as near as the last of the NEIGHBOURS (to a millionth) vote too, so ties don't depend on an order.
        """
        out = np.full(len(tf), 0.5)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for i in range(0, len(tf), block):
            cosine = self.embed(tf[i : i + block]) @ self.vectors.T
            last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            weight = np.where(cosine >= last - 1e-6, np.maximum(cosine, 0), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(1)
            out[i : i + block] = np.where(total > 0, weight @ self.labels / np.maximum(total, 1e-12), 0.5)
        return out


def held_out(ident: Column) -> Column:
    """Rows that a model never learns from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from at most SAMPLE_PER_LABEL labelled texts of each label, those of least hash.

    Held-out ids, null texts and null labels are not learned from. An id with several labels has the
    lesser one; an id with several texts counts once, by the least of its term counts. If one label
    is missing the model knows only the other; with no labelled text at all it scores 0.5. Only the
    sample's term counts reach the driver: 2 * SAMPLE_PER_LABEL rows of the terms that occur.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(ident).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y")).withColumn("at", F.xxhash64("id"))
    first = known.where("y = 0").orderBy("at", "id").limit(SAMPLE_PER_LABEL).unionByName(known.where("y = 1").orderBy("at", "id").limit(SAMPLE_PER_LABEL))
    sample = docs.select(F.col(ident).alias("doc"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(first), F.col("doc") == F.col("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for t in bytes_of(b.column(2)):
                tf = counts(t)
                some = np.flatnonzero(tf)
                packed.append(some.astype(np.uint16).tobytes() + tf[some].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["id", "y", "tf"])

    counted = sample.select("doc", "y", "t").mapInArrow(run, "id long, y int, tf binary").groupBy("id").agg(F.min("y").alias("y"), F.min("tf").alias("tf"))
    rows = sorted(counted.collect(), key=lambda r: r.id)
    if not rows:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    tf = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        n = len(r.tf) // 6
        tf[i, np.frombuffer(r.tf, np.uint16, n)] = np.frombuffer(r.tf, np.int32, n, 2 * n)
    labels_of = np.array([r.y for r in rows], np.float64)
    del rows
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    for i in range(0, len(tf), 256):  # in place, so that the driver holds one matrix
        tf[i : i + 256] = _weigh(tf[i : i + 256], idf)
    power, left = _leading(tf @ tf.T, DIMENSIONS)
    basis = (tf.T @ left / np.sqrt(power)).astype(np.float32) if len(power) else np.zeros((TERMS, 1), np.float32)
    return Model(idf, basis, _latent(tf, basis), labels_of)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs' columns plus the score (double, 0 to 1) of each whole text.

    A null or empty text has no terms and scores 0.5 by the votes' default. Copies score alike. One
    narrow stage: the model is bounded and broadcast, and nothing is shuffled. A column of docs
    named like out, whatever its case, is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                tf = np.array([counts(t) for t in bytes_of(part.column(part.schema.get_field_index(text)))], np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(tf))], names=[*part.schema.names, out])
        _TERMS.clear()  # a worker goes on to other operators

    return kept.mapInArrow(run, StructType(kept.schema.fields[:]).add(out, "double"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
