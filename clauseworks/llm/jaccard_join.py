"""Operator 2, n-gram Jaccard join: MinHash bands shuffled by hash, pairs verified on full n-gram sets.

1. One narrow pass turns each text into a fingerprint of its words, its MinHash bands and one byte
   of each MinHash value. Texts with equal words form a class; only one member of it goes on.
2. Classes are shuffled by band hash. Within a band's bucket, classes whose sketches agree on far
   fewer places than any pair at the threshold would (five standard deviations below) are not
   candidates. A bucket gives the components of its candidates as groups of classes, not as pairs;
   equal groups of several bands are one.
3. All pairs of a group are compared on their full sets of n-grams, in blocks of bounded weight. Where
   groups overlap so much that comparing the whole component of candidates once is cheaper (large
   groups of near copies), that is done instead; a chain of candidates is never compared as a whole.
   What leaves a block is a number of links for each class and a spanning forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm._streams import forest, in_blocks, per_group, small_batches
from clauseworks.llm.shingles import WORDS, hashes, layout, minhash, mix, permutations, windows
from clauseworks.operators.graph import connected_components
from clauseworks.runtime import materialize

#: Members of a bucket's block, and hashes of n-grams (plus a constant for each member) of a verification block.
BUCKET_BLOCK, VERIFY_BLOCK, MEMBER = 4096, 400_000, 1000


def sketches(docs: DataFrame, ident: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(id, content, print, n_shingles, keys, sketch) of each row: null and empty texts have 0 shingles and no keys.

    content is a hash of the text as it stands, by which its row is found again.
    """
    odd, add = permutations(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, keys, sketch = [], [], [], []
            for t in batch.column(2).to_pylist():
                words = t.lower().split() if t else []
                prints.append(xxhash.xxh128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
                s = np.unique(windows(hashes(words), n))
                sizes.append(len(s))
                if not len(s):
                    keys.append([])
                    sketch.append(b"")
                    continue
                least = minhash(s, odd, add)
                sketch.append((least >> np.uint64(40)).astype(np.uint8).tobytes())
                k = np.arange(bands, dtype=np.uint64)
                for i in range(rows):
                    k = mix(k * np.uint64(0x9E3779B97F4A7C15) + least[i::rows])
                keys.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["id", "content", "print", "n_shingles", "keys", "sketch"])
        WORDS.clear()  # a worker goes on to other operators

    return docs.select(F.col(ident).cast("long").alias("id"), F.xxhash64(text).alias("content"), F.col(text).alias("t")).mapInArrow(run, "id long, content long, print binary, n_shingles int, keys array<long>, sketch binary")


def _agreeing(sketch: list[bytes], least: float) -> np.ndarray:
    s = np.array([np.frombuffer(x, np.uint8) for x in sketch])
    agree = np.zeros((len(s), len(s)), np.int16)
    for column in s.T:
        agree += column[:, None] == column
    return agree >= least


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from a 0/1 matrix multiplied in slices of columns."""
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float32)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, 6_000_000 // len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = np.zeros((len(sets), min(width, column[-1] + 1 - k * width)), np.float32)
        m[row[i:j], column[i:j] - k * width] = 1
        out += m @ m.T
    return out


def _components(linked: np.ndarray) -> np.ndarray:
    """The least index reachable from each row of a symmetric boolean matrix; -1 for rows without any link."""
    label = np.full(len(linked), -1)
    for i, j in forest(linked, np.arange(len(linked))).tolist():
        label[i] = label[j] = i if label[i] < 0 else label[i]
    return label


def jaccard_join(docs: DataFrame, ident: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row for each row of docs: id, content, class_id, n_links, component_id, kept.

    Two texts link if the Jaccard similarity of their sets of n-word shingles (lower-cased words
    between white space; a shorter text is one shingle) is threshold or more. class_id is the least
    id with exactly the same words; n_links counts the other rows linked directly, copies included;
    component_id is the least id reachable by links; kept marks one row of each component, a row of
    that id. Bands and rows come from `recall`, the chance to find a pair just at the threshold.
    Null, empty and blank texts link with nothing and are their own component. Ids are integers;
    rows that repeat an id, with the same text or another, are rows of their own that link and are
    counted like any, and only one of them is kept. Rows with a null id link with nothing and come
    out with null class and component, not kept. content is xxhash64 of the text. Other columns of
    docs are not looked at.
    """
    small_batches(docs.sparkSession)
    bands, rows = layout(threshold, recall)
    places = bands * rows
    least = places * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / places))
    base = materialize(sketches(docs, ident, text, n, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = (
        base.where("n_shingles > 0 and id is not null")
        .groupBy("print")
        .agg(F.min(F.struct("id", "row", "content")).alias("of"), F.count("*").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    )
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "print", F.col("of.id").alias("class_id"), F.col("of.row").alias("first_row"), F.col("of.content").alias("first_content"), "size", "keys", "sketch", "n_shingles"), "classes")

    spread = classes.select(F.posexplode("keys").alias("band", "key"), "node", "sketch")

    def bucket(t: pa.Table) -> pa.RecordBatch | None:
        close = _agreeing(t["sketch"].to_pylist(), least)
        nodes, bi, bj = t["node"].to_numpy(), t["bi"][0].as_py(), t["bj"][0].as_py()
        side = np.zeros(len(nodes), np.int32)
        if bi != bj:
            side = np.where(t["own"].to_numpy() == bi, 1, 2).astype(np.int32)
            close &= side[:, None] != side
        np.fill_diagonal(close, False)
        label = _components(close)
        member = np.flatnonzero(label >= 0)
        if not len(member):
            return None
        member = member[np.lexsort((nodes[member], label[member]))]
        starts = np.flatnonzero(np.diff(label[member], prepend=-1))
        size = np.diff(np.append(starts, len(member)))
        # a group is named by all its members, so that bands that give the same one count once
        name = np.add.reduceat(mix((nodes[member] * 4 + side[member] + 1).view(np.uint64)), starts)
        root = nodes[member][starts]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(name.view(np.int64), size)), pa.array(np.repeat(root, size)), pa.array(nodes[member]), pa.array(side[member]), pa.array(np.full(len(member), t["band"][0].as_py(), np.int32))], names=["unit", "root", "node", "side", "band"])

    blocks = in_blocks(spread, ["band", "key"], "node", F.lit(1), BUCKET_BLOCK // 2)
    groups = per_group(blocks, ["band", "key", "bi", "bj"], bucket, "unit long, root long, node long, side int, band int")
    groups = materialize(groups.groupBy("unit", "root", "node", "side").agg(F.min("band").alias("band")), "groups")

    # a component of candidates is compared as a whole where that moves less than its groups do
    candidates = connected_components(groups.select("root", "node"), "root", "node")
    weight = classes.select("node", (F.col("n_shingles") + MEMBER).alias("w"))
    cost = lambda of: (F.sum("w") * F.ceil(F.sum("w") / (VERIFY_BLOCK // 2))).alias(of)
    of_groups = groups.join(weight, "node").groupBy("unit", "root").agg(cost("c")).join(candidates.withColumnRenamed("node", "root"), "root").groupBy("component").agg(F.sum("c").alias("apart"))
    sized = candidates.join(weight, "node")
    whole = sized.groupBy("component").agg(cost("together")).join(of_groups, "component").where("together <= apart").select("component")
    whole = materialize(candidates.join(whole, "component").select("node", F.col("component").alias("unit"), F.lit(-1).alias("band"), F.lit(0).alias("side")), "whole")
    apart = groups.join(whole.select("node"), "node", "left_anti").select("node", "unit", "band", "side")
    # of each class at most one group for each band and block of a bucket
    units = whole.unionByName(apart).groupBy("node").agg(F.collect_list(F.struct("unit", "band", "side")).alias("units"))

    members = classes.join(units, "node").select("node", F.col("class_id").alias("doc"), F.col("first_content").alias("its"), "print", "size", "n_shingles", "keys", "units")
    texts = docs.select(F.col(ident).cast("long").alias("id"), F.xxhash64(text).alias("content"), F.col(text).alias("t"))
    members = members.join(texts, (F.col("doc") == F.col("id")) & (F.col("its") == F.col("content"))).dropDuplicates(["doc", "its", "node"]).select("node", "size", "n_shingles", "keys", "units", "print", "t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(t.lower().split(), p) for t, p in zip(b.column(6).to_pylist(), b.column(5).to_pylist(), strict=True)]
            own = [xxhash.xxh128_digest(" ".join(w).encode("utf-8", "surrogatepass")) == p for w, p in made]
            made = [np.unique(windows(hashes(w), n)).tobytes() for w, _ in made]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(made, pa.binary())], names=["node", "size", "n_shingles", "keys", "units", "shingles"]).filter(pa.array(own))
        WORDS.clear()

    full = materialize(members.mapInArrow(sets, "node long, size long, n_shingles int, keys array<long>, units array<struct<unit: bigint, band: int, side: int>>, shingles binary"), "shingles")

    def verify(t: pa.Table) -> pa.RecordBatch | None:
        nodes, size, band = t["node"].to_numpy(), t["size"].to_numpy(), t["band"][0].as_py()
        s = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        n_s = np.array([len(x) for x in s], np.float64)
        both = _intersections(s).astype(np.float64)
        linked = both >= threshold * (n_s[:, None] + n_s - both) - 1e-9
        np.fill_diagonal(linked, False)
        if t["bi"][0].as_py() != t["bj"][0].as_py():
            own = t["own"].to_numpy()
            linked &= own[:, None] != own
        side = t["side"].to_numpy()
        if side.any():  # the others of a bucket's block were compared in another block
            linked &= side[:, None] != side
        if band > 0:  # a pair that meets in several groups counts in that of its first common band
            keys = np.array(t["keys"].to_pylist(), np.int64)
            for k in range(band):
                linked &= keys[:, None, k] != keys[:, k]
        links = (linked * size).sum(1)
        some = np.flatnonzero(links)
        edges = forest(linked, nodes)
        a = np.concatenate([nodes[some], edges[:, 0]])
        b = np.concatenate([np.full(len(some), -1), edges[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(b)) < len(some)), pa.array(np.concatenate([links[some], np.zeros(len(edges), np.int64)]))], names=["a", "b", "links"])

    keyed = full.select("node", "size", "n_shingles", "keys", "shingles", F.inline("units")).withColumn("keys", F.when(F.col("band") > 0, F.col("keys")))
    parts = in_blocks(keyed, ["unit", "band"], "node", F.col("n_shingles") + MEMBER, VERIFY_BLOCK // 2)
    found = materialize(per_group(parts, ["unit", "band", "bi", "bj"], verify, "a long, b long, links long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    groups = connected_components(found.where("b is not null"))

    result = classes.select("node", "print", "class_id", "first_row", "size").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = result.groupBy("component").agg(F.min(F.struct("class_id", "first_row")).alias("first"))
    result = result.join(firsts, "component").select(F.col("print").alias("of"), "class_id", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("first.class_id").alias("component_id"), F.col("first.first_row").alias("kept_row"))
    # rows without shingles or id have no class; they don't go through the join, where they would share a key
    has = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    inside = base.where(has).select("id", "content", "print", "row").join(result, F.col("print") == F.col("of"))
    inside = inside.select(F.col("id").alias(ident), "content", "class_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("kept_row") == F.col("row")).alias("kept"))
    alone = base.where(~has).select(F.col("id").alias(ident), "content", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    return inside.unionByName(alone)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes, links and components of all documents: 5-word shingles, similarity 0.8."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("content")
