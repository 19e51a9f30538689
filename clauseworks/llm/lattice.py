"""Operator 3, embedding near-dedup: E8 lattice hashing with probes of neighbouring cells.

1. Equal vectors form a class; one member goes on, quantised to a byte a dimension.
2. In each of several tables a random projection to 8 dimensions is decoded to the nearest point of
   the E8 lattice, the vector's cell. A vector is stored in its own cell and also probes the
   neighbouring cells nearest to its projection. In a cell, vectors whose quantised cosine is near
   the threshold or above are candidates; a cell gives a spanning forest of them, not all pairs.
3. Within a component of candidates all vectors are compared in double precision, in blocks. What
   leaves a block is a number of links for each vector and a spanning forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm._streams import forest, in_blocks, per_group, small_batches
from clauseworks.llm.shingles import mix
from clauseworks.operators.graph import connected_components
from clauseworks.runtime import materialize

#: Scales of the projections (cells get smaller as they grow) and numbers of probed neighbours to choose from.
SCALES, PROBES = (0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.3, 1.6, 2.0, 2.5), (3, 6, 12, 24, 48, 96)
#: Chance to find a pair just at the threshold, and the cost of comparing two vectors of a cell against that of a shuffled row.
RECALL, COMPARE = 0.99, 0.02
#: Vectors of a cell's block and of a verification block.
CELL_BLOCK, VERIFY_BLOCK = 4096, 2048


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


NEIGHBOURS = _neighbours()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points whose coordinates have an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    if len(odd):
        gap = x[odd] - near[odd]
        worst = np.abs(gap).argmax(1)
        step = np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        near[odd, worst] += step
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row: the better of the two cosets of the even integer points."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def _key(table: int, width: int, points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of lattice points (their doubled coordinates are whole numbers), by table and vectors' width."""
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    h = np.full(points.shape[:-1], (width << 20) + table + 1, np.uint64)
    for i in range(8):
        h = mix((h + twice[..., i]) * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


@lru_cache(maxsize=256)
def _rank_of_meeting(threshold: float, scale: float, pairs: int = 4000) -> np.ndarray:
    """Of random pairs with this cosine: how many neighbours one of them must probe to meet the other's cell (0: none, 999: too far)."""
    rng = np.random.default_rng(5)
    x, z = rng.standard_normal((2, pairs, 8)) * scale
    y = threshold * x + math.sqrt(1 - threshold * threshold) * z
    px, py = nearest_point(x), nearest_point(y)
    best = np.where((px == py).all(1), 0, 999)
    for u, own, other in ((x, px, py), (y, py, px)):
        hit = (np.abs((other - own)[:, None] - NEIGHBOURS).sum(2) < 1e-9) * 1
        toward = (u - own) @ NEIGHBOURS.T
        at = hit.argmax(1)
        rank = 1 + (toward > np.take_along_axis(toward, at[:, None], 1)).sum(1)
        best = np.minimum(best, np.where(hit.any(1), rank, 999))
    return best


def layout(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int, float]:
    """(tables, probes, scale) that find a pair at the threshold with this chance at the least cost for n vectors.

    The more vectors, the smaller the cells: a vector has (1 + probes) rows in each table, and
    meets the share (4 pi scale^2)^-4 of unrelated vectors in each.
    """
    found = []
    for scale in SCALES:
        met = _rank_of_meeting(threshold, scale)
        for probes in PROBES:
            p = (met <= probes).mean()
            if p > 0.005:
                tables = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))
                found.append((tables * (1 + probes) * (1 + COMPARE * n * (4 * math.pi * scale * scale) ** -4), tables, probes, scale))
    return min(found)[1:]


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int = 11) -> np.ndarray:
    """Keys of each unit vector's cells, (rows, tables, 1 + probes): its own first, then probed neighbours."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        x = unit @ (rng.standard_normal((unit.shape[1], 8)) * scale)
        own = nearest_point(x)
        out[:, t, 0] = _key(t, unit.shape[1], own)
        if probes:
            toward = (x - own) @ NEIGHBOURS.T
            best = np.argpartition(-toward, probes - 1, axis=1)[:, :probes]
            out[:, t, 1:] = _key(t, unit.shape[1], own[:, None, :] + NEIGHBOURS[best])
    return out


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for null, zero or not finite ones."""
    out = []
    for x in column.to_pylist():
        v = None
        if x and None not in x:
            v = np.array(x, np.float64)
            top = np.abs(v).max()
            if np.isfinite(top) and top > 0:
                v = v / top
                v /= np.sqrt((v * v).sum())
            else:
                v = None
        out.append(v)
    return out


def near_vectors(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """One row for each row: id, n_links, component_id, kept.

    Two vectors link if their cosine in double precision is threshold or more. Vectors that are
    null, empty, zero or hold null or non-finite numbers link with nothing, nor do vectors of
    different lengths with each other. n_links counts the other rows linked directly, equal vectors
    included; component_id is the least id reachable; kept marks one row of that id. Ids are integers;
    rows that repeat an id, with the same vector or another, are rows of their own that link and are
    counted like any, and only one of them is kept; rows with a null id link with nothing and have a
    null component, not kept. Other columns are not looked at. Candidates come from lattice cells, laid
    out for the number of distinct vectors and `recall`, the chance to find a pair just at the
    threshold; every link reported is exact.
    """
    small_batches(rows.sparkSession)
    slack = threshold - 0.02

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _vectors(b.column(1))
            raw = [None if x is None else x.tobytes() for x in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if r is None else xxhash.xxh128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["id", "print", "unit"])

    base = materialize(rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(units, "id long, print binary, unit binary").withColumn("row", F.monotonically_increasing_id()), "units")
    classes = base.where("print is not null and id is not null").groupBy("print").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("size"), F.first("unit").alias("unit"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    tables, probes, scale = layout(classes.count(), threshold, recall)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = tables * (1 + probes)
        for b in batches:
            raw = b.column(1).to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, x in enumerate(raw):
                by_length.setdefault(len(x), []).append(i)
            for index in by_length.values():
                for at in range(0, len(index), 128):
                    some = index[at : at + 128]
                    u = np.array([np.frombuffer(raw[i], np.float64) for i in some])
                    top = np.abs(u).max(1, keepdims=True)
                    q = np.rint(u / top * 127).astype(np.int8)
                    keys = cells(u, tables, probes, scale).reshape(-1)
                    ids = np.repeat(b.column(0).to_numpy()[some], per)
                    home = np.tile(np.arange(per) % (1 + probes) == 0, len(some))
                    coarse = np.repeat(np.array([x.tobytes() for x in q], object), per)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(home), pa.array(coarse, pa.binary())], names=["key", "id", "home", "coarse"])

    def cell(t: pa.Table) -> pa.RecordBatch | None:
        home = t["home"].to_numpy()
        if not home.any():
            return None
        coarse = t["coarse"].to_pylist()
        q = np.array([np.frombuffer(x, np.int8) for x in coarse], np.float32)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        close = (q @ q.T >= slack) & (home[:, None] | home)
        ids = t["id"].to_numpy()
        close &= ids[:, None] != ids
        if t["bi"][0].as_py() != t["bj"][0].as_py():
            own = t["own"].to_numpy()
            close &= own[:, None] != own
        edges = forest(close, ids)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    stored = classes.select("node", "unit").mapInArrow(spread, "key long, id long, home boolean, coarse binary")
    candidates = connected_components(per_group(in_blocks(stored, ["key"], "id", F.lit(1), CELL_BLOCK // 2), ["key", "bi", "bj"], cell, "a long, b long"))
    full = materialize(candidates.join(classes, "node").select("component", F.col("node").alias("id"), "size", "unit"), "candidates")

    def verify(t: pa.Table) -> pa.RecordBatch | None:
        u = np.array([np.frombuffer(x, np.float64) for x in t["unit"].to_pylist()])
        linked = u @ u.T >= threshold
        np.fill_diagonal(linked, False)
        if t["bi"][0].as_py() != t["bj"][0].as_py():
            own = t["own"].to_numpy()
            linked &= own[:, None] != own
        ids, links = t["id"].to_numpy(), (linked * t["size"].to_numpy()).sum(1)
        some = np.flatnonzero(links)
        edges = forest(linked, ids)
        b = np.concatenate([np.full(len(some), -1), edges[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], edges[:, 0]])), pa.array(b, mask=np.arange(len(b)) < len(some)), pa.array(np.concatenate([links[some], np.zeros(len(edges), np.int64)]))], names=["a", "b", "links"])

    parts = in_blocks(full, ["component"], "id", F.lit(1), VERIFY_BLOCK // 2)
    found = materialize(per_group(parts, ["component", "bi", "bj"], verify, "a long, b long, links long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    groups = connected_components(found.where("b is not null"))
    result = classes.select("node", "print", "first", "size").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = result.groupBy("component").agg(F.min("first").alias("kept"))
    result = result.join(firsts, "component").select(F.col("print").alias("of"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("kept.id").alias("component_id"), F.col("kept.row").alias("kept_row"))
    has = F.col("print").isNotNull() & F.col("id").isNotNull()
    inside = base.where(has).select("id", "print", "row").join(result, F.col("print") == F.col("of"))
    inside = inside.select(F.col("id").alias(ident), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("kept_row") == F.col("row")).alias("kept"))
    alone = base.where(~has).select(F.col("id").alias(ident), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    return inside.unionByName(alone)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors among all rows of embeddings at cosine 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
