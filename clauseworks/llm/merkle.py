"""Operator 11, Merkle dataset manifest: hash trees over the rows of each group and over the groups.

1. A row is a leaf. Leaves are sorted by (group, order) over range partitions and numbered within
   their group; the leaves of one group in one partition are a run.
2. A run is folded by a stack of open nodes, level by level, as a counter of base `fanout` carries:
   a node is hashed once its last child arrives. Each hashed node is a record. What can't be
   finished, since a sibling lies in another partition, is a peak; a run has few of them.
3. Peaks of neighbouring partitions are folded in the same way, MERGE partitions at a time, until
   each group has its subroot. The last node of a level has what children there are, without padding.
4. The subroots are the leaves of a tree of their own, whose top is the root.
5. For proofs, a run is folded again with the few nodes beyond its edges that its leaves need: all
   of them are peaks or came of merging, so the node records aren't looked up for each leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseworks.llm._streams import per_group, small_batches
from clauseworks.operators.similarity import numbered
from clauseworks.runtime import materialize

#: Leaves of a range partition (about), and partitions whose peaks are merged at a time.
LEAVES_PER_PART, MERGE = 1 << 16, 32
NODE, PEAK, TOP = 0, 1, 2

Step = tuple[int, str]


def digest_of(columns: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the columns: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)).cast("binary"), 256)


def _hash(children: str) -> str:
    return sha256(children.encode()).hexdigest()


def level_sizes(total: int, fanout: int) -> list[int]:
    """Nodes of each level, from the leaves to the top."""
    sizes = [total]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    return sizes


def fold(entries: Iterator[tuple[int, int, str]], sizes: list[int], fanout: int) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(nodes, peaks), each (level, index, digest), of nodes (level, index, digest) in the order of their leaves.

    Nodes are what was hashed here; peaks are entries and nodes whose parent could not be hashed.
    """
    nodes: list[tuple[int, int, str]] = []
    peaks: list[tuple[int, int, str]] = []
    rising: dict[int, tuple[int, list[tuple[int, int, str]]]] = {}
    for level, i, h in entries:
        while sizes[level] > 1:
            parent = i // fanout
            held = rising.get(level)
            if held is None or held[0] != parent:
                if held:
                    peaks += held[1]
                held = rising[level] = (parent, [])
            held[1].append((level, i, h))
            if len(held[1]) < min(fanout, sizes[level] - parent * fanout):
                break
            del rising[level]
            level, i, h = level + 1, parent, _hash("".join(x[2] for x in held[1]))
            nodes.append((level, i, h))
    for _, held in rising.values():
        peaks += held
    return nodes, peaks


def climb(h: str, steps: list[Step]) -> str:
    """The digest at the end of steps (place among the children, digests of the others) from h upwards."""
    for place, others in steps:
        h = _hash(others[: 64 * place] + h + others[64 * place :])
    return h


@dataclass
class Manifest:
    """A hash tree of each group's rows and one of the groups.

    leaves (gid, idx, k, leaf, claim, total, run), nodes (gid, level, idx, digest) without the leaves,
    groups (gid, grp, total), subroots (gid, digest), top: the tree of the subroots (None in that
    tree). gid numbers the groups in their order, idx a group's leaves, level counts from the leaves.
    """

    fanout: int
    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    subroots: DataFrame
    runs: DataFrame
    edges: DataFrame
    top: Manifest | None

    def root(self) -> DataFrame:
        """One row: digest."""
        return self.top.subroots.select("digest")


def _folded(rows: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """fold() of every group of rows (gid, total, part, level, idx, digest); part is handed on, kind tells nodes, peaks and the top."""

    def run(t: pa.Table) -> pa.RecordBatch:
        gid, total, part = t["gid"][0].as_py(), t["total"][0].as_py(), t["part"][0].as_py()
        sizes = level_sizes(total, fanout)
        level, idx = t["level"].to_numpy(), t["idx"].to_numpy()
        order = np.argsort(idx * np.power(np.int64(fanout), level.astype(np.int64)), kind="stable").tolist()
        digest = t["digest"].to_pylist()
        nodes, peaks = fold(((int(level[i]), int(idx[i]), digest[i]) for i in order), sizes, fanout)
        made = [(*x, TOP if x[0] == len(sizes) - 1 else NODE) for x in nodes] + [(*x, PEAK) for x in peaks]
        if total == 1:
            made = [(0, 0, digest[0], TOP)]
        n = len(made)
        columns = [pa.array([gid] * n, pa.int64()), pa.array([total] * n, pa.int64()), pa.array([part] * n, pa.int64()), pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.string()), pa.array([x[3] for x in made], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["gid", "total", "part", "level", "idx", "digest", "kind"])

    return per_group(rows, keys, run, "gid long, total long, part long, level int, idx long, digest string, kind int", least=1)


def _tree(base: DataFrame, fanout: int, is_top: bool) -> Manifest:
    """The trees of a written table (grp, k, leaf, claim, row)."""
    parts = max(1, -(-base.count() // LEAVES_PER_PART))
    order = ["grp", "k", "leaf", "row"]
    ordered = materialize(base.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("at", 33)
    runs = materialize(ordered.groupBy(part.alias("part"), "grp").agg(F.count("*").alias("n"), F.min("at").alias("run")), "runs")
    groups = runs.groupBy("grp").agg(F.sum("n").alias("total"))
    groups = groups.withColumn("gid", F.lit(0).cast("long")) if is_top else numbered(groups, ["grp"], "gid").withColumn("gid", F.col("gid").cast("long"))
    groups = materialize(groups.withColumnRenamed("grp", "of"), "groups")
    before = Window.partitionBy("gid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.join(groups, F.col("grp").eqNullSafe(F.col("of"))).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    runs = materialize(runs.select("run", "part", "grp", "gid", "n", "start", "total"), "runs")
    placed = runs.select("run", "part", F.col("grp").alias("of"), "gid", "start", "total")
    leaves = ordered.withColumn("in_part", part).join(placed, (F.col("in_part") == F.col("part")) & F.col("grp").eqNullSafe(F.col("of")))
    leaves = leaves.select("run", "part", "gid", "total", (F.col("start") + F.col("at") - F.col("run")).alias("idx"), "k", "leaf", "claim")

    found = materialize(_folded(leaves.select("run", "gid", "total", "part", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest")), ["run"], fanout), "nodes")
    every, peaks = [found], found.where(F.col("kind") == PEAK)
    edges = [peaks]
    parts = ordered.select(part.alias("p")).agg(F.max("p").alias("p")).first()["p"] or 0
    while parts > 0:
        parts //= MERGE
        found = materialize(_folded(peaks.withColumn("part", F.floor(F.col("part") / MERGE)).drop("kind"), ["gid", "part"], fanout), "nodes")
        every.append(found)
        edges.append(found.where(F.col("kind") != PEAK))
        peaks = found.where(F.col("kind") == PEAK)
    made = reduce(DataFrame.unionByName, every)
    subroots = made.where(F.col("kind") == TOP).select("gid", "digest")
    top = None
    if not is_top:
        tops = subroots.select(F.lit(0).alias("grp"), F.col("gid").alias("k"), F.col("digest").alias("leaf"), F.col("digest").alias("claim"), F.lit(0).cast("long").alias("row"))
        top = _tree(materialize(tops, "subroots"), fanout, True)
    nodes = made.where((F.col("kind") != PEAK) & (F.col("level") > 0)).select("gid", "level", "idx", "digest")
    return Manifest(fanout, leaves, nodes, groups.withColumnRenamed("of", "grp"), subroots, runs, reduce(DataFrame.unionByName, edges).select("gid", "level", "idx", "digest"), top)


def manifest(rows: DataFrame, ident: str, columns: list[str], group: str, fanout: int = 2, claims: Callable[[DataFrame], Column] | None = None) -> Manifest:
    """The hash trees of rows: a leaf for each row, digest_of(columns), in the group of `group`, ordered by `ident`.

    Groups are ordered by value, null first, strings by bytes. Rows without an id come first in their
    group; rows that repeat an id follow the order of their digests, so the tree doesn't depend on the
    order of rows; equal rows are leaves of their own. `claims` gives for each row the digest that
    proofs() tests in place of its own (null: its own). Only the named columns are read. An empty
    table has no groups and no root.
    """
    if fanout < 2:
        raise ValueError("a node needs two children or more")
    small_batches(rows.sparkSession)
    leaf = digest_of([rows[c] for c in columns])
    claim = claims(rows) if claims else F.lit(None).cast("string")
    base = rows.select(rows[group].alias("grp"), rows[ident].alias("k"), leaf.alias("leaf"), claim.alias("claim"))
    return _tree(materialize(base.withColumn("row", F.monotonically_increasing_id()), "digests"), fanout, False)


def _beyond(runs: DataFrame, fanout: int) -> DataFrame:
    """(run, gid, level, idx): the nodes that a run's proofs need and that don't lie within it: siblings along its two edges."""

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for x in b.to_pylist():
                first, last, width = x["start"], x["start"] + x["n"], 1
                for level, size in enumerate(level_sizes(x["total"], fanout)[:-1]):
                    found = set()
                    for leaf in (first, last - 1):
                        lo = leaf // width // fanout * fanout
                        found |= set(range(lo, min(lo + fanout, size)))
                    out += [(x["run"], x["gid"], level, j) for j in found if j * width < first or min((j + 1) * width, x["total"]) > last]
                    width *= fanout
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["run", "gid", "level", "idx"])

    return runs.select("run", "gid", "start", "n", "total").mapInArrow(needed, "run long, gid long, level int, idx long")


def _steps(known: list[dict[int, str]], sizes: list[int], fanout: int, i: int) -> list[Step]:
    """The way from leaf i to the top: its place among its parent's children and the digests of the others, and so on."""
    out = []
    for level in range(len(sizes) - 1):
        lo = i - i % fanout
        of = known[level]
        out.append((i - lo, "".join(of[j] for j in range(lo, min(lo + fanout, sizes[level])) if j != i)))
        i //= fanout
    return out


def _per_leaf(m: Manifest, more: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """emit(rows of a run's leaves, its extra row, steps of a leaf) for every run; more (gid, more) is handed to the runs of each group."""
    fanout = m.fanout
    beyond = _beyond(m.runs, fanout).join(m.edges, ["gid", "level", "idx"]).select("run", "level", "idx", "digest")
    own = m.leaves.select("run", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"), "k", "claim", "total")
    extra = m.runs.join(more, "gid").select("run", F.lit(-1).alias("level"), "more")
    rows = own.unionByName(beyond, allowMissingColumns=True).unionByName(extra, allowMissingColumns=True)

    def run(t: pa.Table) -> pa.RecordBatch:
        level, total = t["level"].to_numpy(), t["total"].to_numpy(zero_copy_only=False)
        is_own = ~np.isnan(total.astype(np.float64))
        leaves = t.take(np.flatnonzero(is_own)).sort_by("idx")
        sizes = level_sizes(leaves["total"][0].as_py(), fanout)
        known: list[dict[int, str]] = [{} for _ in sizes]
        idx, digest = leaves["idx"].to_pylist(), leaves["digest"].to_pylist()
        known[0] = dict(zip(idx, digest, strict=True))
        for at, j, h in fold(((0, i, h) for i, h in zip(idx, digest, strict=True)), sizes, fanout)[0]:
            known[at][j] = h
        for i in np.flatnonzero(~is_own & (level >= 0)).tolist():
            known[level[i]][t["idx"][i].as_py()] = t["digest"][i].as_py()
        of = t["more"][int(np.flatnonzero(level < 0)[0])].as_py()
        return emit(leaves, of, lambda i: _steps(known, sizes, fanout, i))

    return per_group(rows, ["run"], run, schema, least=1)


def proofs(m: Manifest, ident: str, with_steps: bool = False) -> DataFrame:
    """A row for each leaf: ident, leaf, subroot, root, proof_sha256, folded_root, verified (and steps).

    A proof is the digests of the siblings from the leaf via its subroot to the root, level by level and
    left to right in each (steps: place among the children, siblings); proof_sha256 is the hash of all
    of them. folded_root is computed from the claim of the row (its own digest where that is null) and
    the siblings, and verified tells whether it is the root. Where a tree has one leaf, its proof is empty.
    """
    step = "array<struct<place: int, others: string>>"
    paths = _per_leaf(m.top, m.top.runs.select("gid", F.lit(0).alias("more")).distinct(), _ways, f"k long, steps {step}")
    root = m.root().select(F.lit(0).cast("long").alias("one"), F.col("digest").alias("root"))
    more = paths.join(m.subroots, F.col("k") == F.col("gid")).withColumn("one", F.lit(0).cast("long")).join(root, "one")
    more = materialize(more.select("gid", F.struct("digest", "root", "steps").alias("more")), "tops")
    kind = m.leaves.schema["k"].dataType.simpleString()

    def emit(leaves: pa.Table, of: dict, steps: Callable[[int], list[Step]]) -> pa.RecordBatch:
        above = [(x["place"], x["others"]) for x in of["steps"]]
        proof, folded, ways = [], [], []
        for i, h, claim in zip(leaves["idx"].to_pylist(), leaves["digest"].to_pylist(), leaves["claim"].to_pylist(), strict=True):
            way = steps(i) + above
            proof.append(_hash("".join(x for _, x in way)))
            folded.append(climb(claim or h, way))
            if with_steps:
                ways.append([{"place": p, "others": x} for p, x in way])
        n = len(folded)
        columns = [leaves["k"].combine_chunks(), leaves["digest"].combine_chunks(), pa.array([of["digest"]] * n), pa.array([of["root"]] * n), pa.array(proof), pa.array(folded), pa.array([x == of["root"] for x in folded])]
        names = [ident, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        if with_steps:
            columns, names = [*columns, pa.array(ways, pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())])))], [*names, "steps"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{ident}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _per_leaf(m, more, emit, schema + (f", steps {step}" if with_steps else ""))


def _ways(leaves: pa.Table, _: object, steps: Callable[[int], list[Step]]) -> pa.RecordBatch:
    ways = [[{"place": p, "others": x} for p, x in steps(i)] for i in leaves["idx"].to_pylist()]
    return pa.RecordBatch.from_arrays([leaves["k"].combine_chunks(), pa.array(ways, pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())])))], names=["k", "steps"])


COLUMNS, EVERY = ["doc_id", "source", "lang", "n_chars", "text"], 7


def tampered(docs: DataFrame) -> Column:
    """The digest of a row with one more character than there are, where 7 divides the crc32 of its id; else null."""
    more = [docs[c] if c != "n_chars" else (docs[c].cast("decimal(20,0)") + 1).cast("decimal(20,0)") for c in COLUMNS]
    return F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % EVERY == 0, digest_of(more))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document and whether it holds; a seventh of the documents are tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    return proofs(manifest(docs, "doc_id", COLUMNS, "lang", 2, tampered), "doc_id")


#: crc32 of a text of few ASCII characters, bit by bit.
_BITS = "list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, xor({c}, {x}))"


def crc32_sql(text: str) -> str:
    """The crc32 of a text in DuckDB, which has no function for it."""
    step = _BITS.format(c="a", x="b")
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: cast(ord(x) as bigint)), lambda a, b: {step}, cast(4294967295 as bigint)), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(cast(octet_length(encode(cast({c} as varchar))) as varchar) || ':' || cast({c} as varchar), '-')"


_LEAF = lambda chars: "sha256(" + " || ".join(_field(c if c != "n_chars" else chars) for c in COLUMNS) + ")"

#: Both trees are built level by level, and each leaf climbs from its sibling's level to the next.
OP11_SQL = f"""
with recursive leaves as (
  select doc_id, lang, {_LEAF('n_chars')} as leaf, case when {crc32_sql("cast(doc_id as varchar)")} % {EVERY} = 0 then {_LEAF('n_chars + 1')} else {_LEAF('n_chars')} end as claim from documents
), placed as (
  select *, dense_rank() over (order by encode(lang) nulls first) - 1 as gid, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as total from leaves
), node as (
  select gid, 0 as level, idx, leaf as h, total from placed
  union all select gid, level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), any_value((total + 1) // 2) from node where total > 1 group by gid, level, idx // 2
), upper as (
  select 0 as level, gid as idx, h, count(*) over () as total from node where total = 1
  union all select level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), any_value((total + 1) // 2) from upper where total > 1 group by level, idx // 2
), every as (
  select gid, level, idx, h, total from node union all select -1, level, idx, h, total from upper
), way as (
  select row_number() over () as r, gid, gid as tree, 0 as level, idx, '' as proof, claim as h, total from placed
  union all
  select w.r, w.gid, case when w.total = 1 then -1 else w.tree end, case when w.total = 1 then 0 else w.level + 1 end, case when w.total = 1 then w.gid else w.idx // 2 end,
         w.proof || case when w.total = 1 then '' else coalesce(s.h, '') end,
         case when w.total = 1 then w.h when s.h is null then sha256(w.h) when w.idx % 2 = 0 then sha256(w.h || s.h) else sha256(s.h || w.h) end,
         case when w.total = 1 then (select count(distinct gid) from placed) else (w.total + 1) // 2 end
  from way w left join every s on s.gid = w.tree and s.level = w.level and s.idx = xor(w.idx, 1) where w.total > 1 or w.tree >= 0
), ended as (select r, proof, h from way where tree = -1 and total = 1), numbered as (select *, row_number() over () as r from placed)
select n.doc_id, n.leaf, s.h as subroot, u.h as root, sha256(e.proof) as proof_sha256, e.h as folded_root, e.h = u.h as verified
from numbered n join ended e on e.r = n.r join node s on s.gid = n.gid and s.total = 1 join upper u on u.total = 1
"""
