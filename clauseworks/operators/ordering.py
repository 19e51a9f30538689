"""Consecutive numbers for the rows of a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.runtime import materialize


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with consecutive numbers from 0 in order: a sort by ranges, numbers within each range, and the ranges' offsets."""
    return _numbered(rows, order, name).drop("__part")


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """numbered, with the range of each row as __part."""
    spark = rows.sparkSession
    sorted_rows = materialize(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    counts = sorted_rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).orderBy("__part").collect()  # one row for each partition
    offset, ahead = [], 0
    for r in counts:
        offset.append((r["__part"], ahead))
        ahead += r["__n"]
    offsets = F.broadcast(spark.createDataFrame(offset or [(0, 0)], "__part long, __ahead long"))
    with_part = sorted_rows.withColumn("__part", part).join(offsets, "__part")
    return with_part.withColumn(name, F.col("__ahead") + F.col("__at").bitwiseAND((1 << 33) - 1)).select(*rows.columns, name, "__part")


def numbered_within(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with consecutive numbers from 0 in order within each value of the keys (not null); no task holds a key."""
    placed = _numbered(rows, [*keys, *order], "__place")
    starts = placed.groupBy(*keys).agg(F.min("__place").alias("__start"), F.collect_set("__part").alias("__parts"))
    # a key's rows are met range by range, since all of them may have one key
    return placed.join(starts.withColumn("__part", F.explode("__parts")).drop("__parts"), [*keys, "__part"]).withColumn(name, F.col("__place") - F.col("__start")).select(*rows.columns, name)
