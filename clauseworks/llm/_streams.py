"""Arrow helpers: groups of a sorted partition as NumPy slices, and splitting of hot groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseworks.runtime import small_batches  # noqa: F401  the operators take it from here


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bytes_of(column: pa.Array) -> list[memoryview]:
    """The values of a binary or string column as views without copies; null gives an empty view."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 2) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (sorted input, keys not null) that have `least` rows or more."""
    rest: pa.Table | None = None

    def runs(table: pa.Table, last: bool) -> tuple[list[tuple[int, int]], int]:
        new = np.zeros(len(table), bool)
        for k in keys:
            v = table[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        new[0] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(table))
        keep = len(starts) if last else len(starts) - 1
        big = np.flatnonzero(ends[:keep] - starts[:keep] >= least)
        return [(int(starts[i]), int(ends[i])) for i in big], int(starts[-1])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, final = held[0], batch
        if all(first[k][0].as_py() == final[k][-1].as_py() for k in keys):
            continue  # one group so far
        table = pa.Table.from_batches(held)
        found, tail = runs(table, False)
        for i, j in found:
            yield table.slice(i, j - i)
        rest = table.slice(tail)
        held = rest.to_batches()
    if held:
        table = pa.Table.from_batches(held)
        for i, j in runs(table, True)[0]:
            yield table.slice(i, j - i)


def per_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, least: int = 2) -> DataFrame:
    """fn over every group of keys that has `least` rows or more, streamed from sorted partitions.

    Groups must be bounded (see in_blocks). Outputs are batched so that many tiny groups stay cheap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        rows = 0
        for table in groups(batches, keys, least):
            made = fn(table)
            if made is not None and made.num_rows:
                out.append(made)
                rows += made.num_rows
                if rows >= 20_000:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, rows = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def in_blocks(rows: DataFrame, keys: list[str], ident: str, weight: Column, limit: int) -> DataFrame:
    """Split heavy groups: adds own (a row's block), bi and bj.

    Each group of keys gets ceil(its weight / limit) blocks. A row goes to all pairs of blocks that
    hold its own, so any two rows of a group meet in exactly one (keys, bi, bj) and none of those is heavy.
    """
    heavy = rows.groupBy(*keys).agg(F.ceil(F.sum(weight) / limit).alias("blocks")).where("blocks > 1")
    salted = rows.join(heavy, keys, "left").withColumn("own", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(ident), "blocks")).cast("int"))
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    return salted.withColumn("other", F.explode(other)).select(*rows.columns, "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))


def forest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Edges (ids, two columns) of a spanning forest of a symmetric boolean matrix: at most one for each row.

    Trees grow from their least ids, so that groups that overlap give equal edges.
    """
    order = np.argsort(ids, kind="stable")
    fresh = np.ones(len(ids), bool)
    out: list[np.ndarray] = []
    for root in order[linked.any(1)[order]].tolist():
        if not fresh[root]:
            continue
        fresh[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            found = np.flatnonzero(linked[u] & fresh)
            if len(found):
                fresh[found] = False
                out.append(np.stack([np.full(len(found), ids[u]), ids[found]], 1))
                queue += found.tolist()
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)
