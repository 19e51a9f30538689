"""Streams: the append-only feedback log, and incremental work on what a cache lacks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.runtime import shared_dir
from clauseworks.sources.tables import FEEDBACK, read_feedback


def feedback_metrics(feedback: DataFrame) -> DataFrame:
    """Rows, mean rating and distinct sessions; the same for a batch and for a stream's snapshot."""
    return feedback.agg(F.count("*").alias("total"), F.round(F.avg("rating"), 6).alias("rating"), F.count_distinct("session_id").alias("sessions"))


def ingest_feedback(spark: SparkSession, source: str, table: str, checkpoint: str) -> None:
    """Move what the log has gained since the last call into a Parquet table, once."""
    stream = read_feedback(spark, source, stream=True)
    stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def process_misses(source: DataFrame, cache: str, key: str, work) -> DataFrame:
    """work(rows) on the rows whose key the cache table lacks, appended to it; returns the cache.

    Meant for foreachBatch as well as for batches: a batch that is run again finds its keys there.
    """
    spark = source.sparkSession
    try:
        known = spark.read.parquet(cache).select(key)
        misses = source.join(known, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        misses = source
    work(misses.dropDuplicates([key])).write.mode("append").parquet(cache)
    return spark.read.parquet(cache)


def events_by_window(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of a stream of events by window and type, with a watermark for late ones."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def streamed_feedback(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Write rows as a JSON log, ingest it by a stream that ends when all is read, and give the metrics."""
    base = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    given = {c.split()[0] for c in FEEDBACK.split(", ")} & set(rows.columns)
    rows.select(*sorted(given)).write.json(f"{base}/log")
    ingest_feedback(spark, f"{base}/log", f"{base}/table", f"{base}/checkpoint")
    return feedback_metrics(spark.read.parquet(f"{base}/table"))
