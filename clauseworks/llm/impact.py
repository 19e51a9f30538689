"""Operator 12, exact top-k search: an impact-ordered index of vectors, searched score at a time.

1. Vectors become whole numbers and are dealt into blocks. A block's index holds for each dimension
   the vectors in segments of like values (quantised), each with its least and greatest value.
2. A score q.v is (g q.q + v.v / g) / 2 less, for each dimension d, (g q_d - v_d)^2 / 2g, whatever g > 0 is.
   The least that a segment takes off is its impact. Segments are processed by descending impact, and
   what their vectors lose is taken off those vectors' bounds, which start from the first term.
3. After each share of the segments the vectors of the greatest bounds are scored. Vectors whose bound is
   below the k-th best score known are out by proof; once few are left, or no segment is, those are scored exactly.
4. The first block of all gives each query a score that its k-th best can't be below; the others
   start from it. The best of all blocks are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseworks.llm._streams import per_group, small_batches
from clauseworks.runtime import materialize

#: Values of a block of the index, its greatest number of vectors, values of a batch of queries.
BLOCK_VALUES, MOST_IN_BLOCK, BATCH_VALUES = 1 << 20, 1 << 14, 1 << 16
#: Segments of a dimension, shares of a block's entries after which the bounds are looked at, members (times k) that are
#: scored then, and the share of a block's vectors that ends the processing as possible members.
LEVELS, LOOKS, FEW, SHARE = 16, (0.25, 0.35, 0.45, 0.6, 0.8, 1.0), 4, 1 / 16
LEAST_SCORE = -(1 << 62)


def _whole(column: pa.Array, scale: float) -> list[bytes | None]:
    """floor(scale * x) of each component as 32-bit numbers; None for vectors that take no part."""
    out = []
    for x in column.to_pylist():
        made = None
        if x and None not in x:
            v = np.floor(scale * np.array(x, np.float64))
            if np.isfinite(v).all() and np.abs(v).max() < 2.0**30 / len(v) ** 0.5:
                made = v.astype(np.int32).tobytes()
        out.append(made)
    return out


class Block:
    """The vectors of a block (whole numbers, one row each) in segments of each dimension."""

    def __init__(self, values: np.ndarray, order: np.ndarray, ends: np.ndarray) -> None:
        n, dims = values.shape
        self.greatest_of_all = int(np.abs(values).max(initial=0))
        self.values, self.floats = values.astype(np.int64), values.astype(np.float64)
        self.squares = np.einsum("ij,ij->i", self.floats, self.floats)
        self.order = order  # vectors by dimension and descending value
        starts = np.concatenate([[0], ends[:-1]])
        some = ends > starts
        self.starts, self.ends, self.dim = starts[some], ends[some], np.repeat(np.arange(dims), LEVELS)[some]
        self.sorted = np.take_along_axis(self.floats, order.astype(np.intp).reshape(dims, n).T, 0).T.reshape(-1)
        self.greatest, self.least = self.sorted[self.starts], self.sorted[self.ends - 1]

    @staticmethod
    def build(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, ends): vectors of each dimension by descending value, and where its segments end."""
        n, dims = values.shape
        order = np.argsort(-values.astype(np.int64), axis=0, kind="stable").T
        lo, hi = values.min(0).astype(np.int64), values.max(0).astype(np.int64)
        level = (hi[None] - values) * LEVELS // (hi - lo + 1)[None]
        counts = np.stack([np.bincount(level[:, d], minlength=LEVELS) for d in range(dims)])
        return order.reshape(-1), np.cumsum(counts.reshape(-1))

    def exact(self, members: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The scores of members. Whole numbers below 2^53 are exact in double precision as well, and much faster."""
        if int(np.abs(q).max()) * self.greatest_of_all * len(q) < 1 << 53:
            return (self.floats[members] @ q.astype(np.float64)).astype(np.int64)
        return self.values[members] @ q

    def search(self, q: np.ndarray, k: int, least: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(members, scores): the vectors that can be among the k best and score `least` or more, own left out."""
        n, dims = self.values.shape
        square = float(q.astype(np.float64) @ q)
        g = (self.squares.mean() / square) ** 0.5 if square and self.squares.any() else 1.0
        at = g * q
        meets = at[self.dim]
        impact = np.maximum(meets - self.greatest, self.least - meets)
        by = np.argsort(-impact, kind="stable")
        by = by[impact[by] > 0]  # the others may take nothing off
        entries = np.cumsum(self.ends[by] - self.starts[by])
        bound = (g * square + self.squares / g) / 2
        slack = float(bound.max()) * (dims + 8) * 1e-15  # for rounding
        if 0 <= own < n:
            bound[own] = -np.inf
        done, top = 0, min(n, FEW * k + 1)
        for look in LOOKS:
            upto = int(np.searchsorted(entries, look * n * dims, "right"))
            if upto > done:
                bound -= self._lost(np.sort(by[done:upto]), at) / (2 * g)
                done = upto
            best = np.argpartition(bound, n - top)[n - top :]
            best = best[best != own]
            if len(best) >= k:
                least = max(least, int(np.partition(self.exact(best, q), len(best) - k)[len(best) - k]))
            members = np.flatnonzero(bound >= least - slack)
            if len(members) <= max(top, SHARE * n) or done == len(by):
                break
        members = members[members != own]
        exact = self.exact(members, q)
        stay = exact >= least
        return members[stay], exact[stay]

    def _lost(self, segments: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each vector, the squares of its distances from `at` in the segments (ascending) that hold it."""
        breaks = np.flatnonzero(np.diff(segments) != 1) + 1
        runs = list(zip(self.starts[segments[np.append(0, breaks)]].tolist(), self.ends[segments[np.append(breaks, len(segments)) - 1]].tolist(), strict=True))
        far = np.concatenate([self.sorted[a:b] for a, b in runs])
        far -= np.repeat(at[self.dim[segments]], self.ends[segments] - self.starts[segments])
        far *= far
        return np.bincount(np.concatenate([self.order[a:b] for a, b in runs]), far, len(self.values))


def _numbers(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _searched(index: DataFrame, batches: DataFrame, k: int) -> DataFrame:
    """The k best of every block of the index for the queries of every batch of as many dimensions."""
    n_batches = batches.groupBy("dims").agg(F.max("batch").alias("last"))
    cells = index.join(n_batches, "dims").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last").join(batches, ["dims", "batch"])

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for part in parts:
            for r in range(part.num_rows):
                of = lambda c, kind: _numbers(part.column(part.schema.get_field_index(c))[r], kind)  # noqa: B023, E731
                dims, name = part.column(0)[r].as_py(), part.column(1)[r].as_py()
                ids, rows = of("ids", np.int64), of("rows", np.int64)
                if (dims, name) != last:
                    block, last = Block(of("values", np.int32).reshape(-1, dims), of("order", np.uint16), of("ends", np.int64)), (dims, name)
                by_row = np.argsort(rows)
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for qid, qrow, least, q in zip(of("q_ids", np.int64).tolist(), of("q_rows", np.int64).tolist(), of("q_least", np.int64).tolist(), of("q_values", np.int32).reshape(-1, dims).astype(np.int64), strict=True):
                    i = min(int(np.searchsorted(rows, qrow, sorter=by_row)), len(rows) - 1)
                    own = int(by_row[i]) if rows[by_row[i]] == qrow else -1
                    members, scores = block.search(q, k, least, own)
                    best = np.lexsort((rows[members], ids[members], -scores))[:k]
                    for o, v in zip(out, (np.full(len(best), qid), np.full(len(best), qrow), ids[members][best], rows[members][best], scores[best]), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], names=["query_id", "query_row", "vec_id", "vec_row", "score"])

    columns = ["dims", "block", "ids", "rows", "values", "order", "ends", "q_ids", "q_rows", "q_values", "q_least"]
    return cells.select(*columns).mapInArrow(search, "query_id long, query_row long, vec_id long, vec_row long, score long")


def build_index(vectors: DataFrame) -> DataFrame:
    """A row for each block (dims, block): ids, rows, values, order, ends, of vectors (id, row, dims, v)."""
    in_block = F.least(F.lit(MOST_IN_BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.col("dims"))))
    sizes = vectors.groupBy("dims").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / (in_block * 0.9))).select("dims", "blocks")
    dealt = vectors.join(sizes, "dims").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))

    def build(t: pa.Table) -> pa.RecordBatch:
        dims = t["dims"][0].as_py()
        values = np.frombuffer(b"".join(t["v"].to_pylist()), np.int32).reshape(-1, dims)
        out = []
        for at in range(0, len(values), MOST_IN_BLOCK):  # a block by hash can be a little larger than meant
            some = slice(at, at + MOST_IN_BLOCK)
            order, ends = Block.build(values[some])
            out.append((dims, t["block"][0].as_py() * 1000 + at // MOST_IN_BLOCK, t["id"].to_numpy()[some].tobytes(), t["row"].to_numpy()[some].tobytes(), values[some].tobytes(), order.astype(np.uint16).tobytes(), ends.tobytes()))
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["dims", "block", "ids", "rows", "values", "order", "ends"])

    return per_group(dealt.select("dims", "block", "id", "row", "v"), ["dims", "block"], build, "dims int, block long, ids binary, rows binary, values binary, order binary, ends binary", least=1)


def _batches(queries: DataFrame, least: DataFrame | None) -> DataFrame:
    """A row for each batch of queries (id, row, dims, v) of as many dimensions, with the score from which each takes results."""
    per = F.greatest(F.lit(1), F.floor(F.lit(BATCH_VALUES) / F.col("dims")))
    sizes = queries.groupBy("dims").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / per)).select("dims", "parts")
    dealt = queries.join(sizes, "dims").withColumn("batch", F.pmod(F.xxhash64("row"), "parts"))
    if least is None:
        dealt = dealt.withColumn("least", F.lit(LEAST_SCORE + 1))
    else:
        dealt = dealt.join(least, "row", "left").withColumn("least", F.coalesce("least", F.lit(LEAST_SCORE + 1)))

    def pack(t: pa.Table) -> pa.RecordBatch:
        cells = [t["id"].to_numpy().tobytes(), t["row"].to_numpy().tobytes(), b"".join(t["v"].to_pylist()), t["least"].to_numpy().tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([t["dims"][0].as_py()], pa.int32()), pa.array([t["batch"][0].as_py()], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["dims", "batch", "q_ids", "q_rows", "q_values", "q_least"])

    return per_group(dealt.select("dims", "batch", "id", "row", "v", "least"), ["dims", "batch"], pack, "dims int, batch long, q_ids binary, q_rows binary, q_values binary, q_least binary", least=1)


def top_k(rows: DataFrame, k: int = 5, ident: str = "vec_id", vector: str = "embedding", queries: str = "vec_id % 50 = 0", scale: float = 256.0) -> DataFrame:
    """The k best of all other rows for every row that meets `queries`: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x); the score is the inner product in whole numbers, ties go to
    the smaller id. Fewer than k rows are all returned. Ids are integers; rows that repeat an id are
    rows of their own, as queries too (their results have the same query_id), and ties of one id go by
    row. Rows without an id, and vectors that are null, empty, hold null or non-finite components, or
    are so large that a score might not be a long (dimensions times the greatest square of 2^60 or
    more) take no part. Vectors of different lengths are not compared. Other columns aren't read.
    """
    small_batches(rows.sparkSession, rows=1000)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _whole(b.column(1), scale)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else len(x) // 4 for x in v], pa.int32()), pa.array(v, pa.binary()), b.column(2)], names=["id", "dims", "v", "asks"])

    given = rows.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("e"), F.coalesce(F.expr(queries), F.lit(False)).alias("asks"))
    vectors = materialize(given.mapInArrow(whole, "id long, dims int, v binary, asks boolean").where("dims is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    index = materialize(build_index(vectors.drop("asks")), "index")
    asked = vectors.where("asks").drop("asks")
    first = index.groupBy("dims").agg(F.min("block").alias("block"))
    begun = materialize(_searched(index.join(first, ["dims", "block"], "left_semi"), _batches(asked, None), k), "begun")
    least = begun.groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").alias("least")).where(f"n = {k}").select("row", "least")
    rest = _searched(index.join(first, ["dims", "block"], "left_anti"), materialize(_batches(asked, least), "queries"), k)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    return begun.unionByName(rest).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP12_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e, row_number() over () as r from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, q.r as query_row, d.vec_id, d.r, cast(list_inner_product(q.e, d.e) as bigint) as score
  from v q join v d on q.vec_id % 50 = 0 and q.r <> d.r and len(q.e) = len(d.e)
), ranked as (select *, row_number() over (partition by query_row order by score desc, vec_id, r) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 5
"""
