"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.runtime import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node id reachable.

    Randomised contraction: in each round every node moves to the node of least hash (another hash
    in each round) among itself and its neighbours, and edges are drawn between the nodes moved to.
    The first round goes by the ids themselves, which settles stars around their least ids at once.
    Each later round leaves a constant share of the nodes at most (about half on a chain, far less on
    stars), whatever the ids, so edges are gone after a number of rounds that grows with the
    logarithm of a component. The moves are then followed back, and each component gets its least
    node. A round is written to the shared folder; only whether edges are left is asked.
    Self edges and repeated edges do no harm; rows with a null end are ignored; an empty table
    gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    left = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda c: F.xxhash64(c, F.lit(len(moves))) if moves else F.col(c)
        near = left.groupBy("u").agg(F.min_by("v", rank("v")).alias("v"), F.min(rank("v")).alias("h"))
        move = materialize(near.select(F.col("u").alias("node"), F.when(F.col("h") < rank("u"), F.col("v")).otherwise(F.col("u")).alias("root")), "moves")
        moves.append(move)
        start = move.select(F.col("node").alias("u"), F.col("root").alias("x"))
        end = move.select(F.col("node").alias("v"), F.col("root").alias("y"))
        fewer = materialize(left.where("u <> v").join(start, "u").join(end, "v").where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "edges")
        discard(left)
        left = fewer
    if not moves:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = moves.pop()
    while moves:
        further = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        step = moves.pop().join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        if len(moves) % 4 == 0:
            step = materialize(step, "labels")
        labels = step
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return materialize(labels.join(least, "root").select("node", "component"), "labels")
