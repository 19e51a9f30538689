"""A corpus pipeline of the numbered operators: from documents to encoded, clean, distinct texts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet and
reads again as the next one's docs. All stages but the last return the columns of documents; other
columns of docs, whatever their names, are handed on as they are. Rows that repeat an id or a whole
row are documents of their own except where a stage says otherwise; no stage depends on an order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm import byte_bpe, decontaminate, jaccard_join, line_templates, quality
from clauseworks.runtime import materialize, release, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores as label 1; equal texts score alike, and null and empty ones have no score to reject them by."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free(docs, "quality_score")
    return quality.score(docs, model, out=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of templates that recur across documents; a text that loses all its lines goes.

    Rows of one id are one document here: lines that they share stay in all of them.
    """
    n_lines, n_dropped = _free(docs, "n_lines"), _free(docs, "n_dropped")
    done = line_templates.dedup_lines(docs, n_lines=n_lines, n_dropped=n_dropped).where((F.col(n_dropped) == 0) | (F.col(n_dropped) < F.col(n_lines)))
    changed = F.col(n_dropped) > 0
    return done.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: one of least id.

    Of rows with the same id and text one stays (which, if their other columns differ, is not
    defined). Rows without an id stay, and so do null and blank texts, which are near to nothing.
    """
    content = _free(docs, "content")
    rows = jaccard_join.jaccard_join(docs).where("doc_id is not null").groupBy("doc_id", "content").agg(F.count_if("kept").alias("stay"), F.count("*").alias("n"))
    rows = materialize(rows.where("stay < n").withColumnRenamed("content", content), "others")
    hashed = docs.withColumn(content, F.xxhash64("text"))
    once = rows.where("stay > 0").select("doc_id", content)
    left = hashed.join(rows.select("doc_id", content), ["doc_id", content], "left_anti")
    if not once.isEmpty():
        left = left.unionByName(hashed.join(once, ["doc_id", content], "left_semi").dropDuplicates(["doc_id", content]))
    return left.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows of one id go together. Null and empty texts hold none."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their number of tokens and the digests of their ids and decoded texts (0 tokens for null and empty ones).

    Columns of docs that have the name of one of the three are replaced.
    """
    return byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: SQL can't express nearest-neighbour votes, MinHash joins, SimHash windows or the merges; see tests/llm/.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again; what a stage wrote besides is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
        release(spark, before, docs)
    return docs
