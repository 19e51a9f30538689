"""TF-IDF, similarity edges, groups of similar clauses, near-duplicate removal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.functions import text as r
from clauseworks.functions.dialect import SPARK, Spark, run
from clauseworks.operators.graph import connected_components
from clauseworks.operators.nearness import greedy_near
from clauseworks.operators.ordering import numbered
from clauseworks.operators.staging import ATTACH, CORE, settled_stages, staged_clusters  # noqa: F401
from clauseworks.runtime import materialize

#: Common words that carry no topic; a parameter of every operator below.
STOP_WORDS = (
    "a about above after again all also an and any are as at be because been before being below between both but by can could did do does down during each few for "
    "from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out "
    "over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with you your"
).split()
MOST_TERMS, MOST_SHARE = 500, 0.95
BASE, LARGE_BUCKET, LARGE = 0.35, 100, 0.45
STAGED_SIZE = 150


def tfidf_sql(d: Spark, clauses: str, stop: tuple[str, ...] | list[str] = STOP_WORDS) -> str:
    """DuckDB's check of tfidf, in the plain form of one table of terms."""
    words = ", ".join(map(d.lit, stop))
    tokens = f"(select bucket, idx, unnest(range(len(l))) as pos, unnest(l) as w from (select bucket, idx, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: not list_contains([{words}], w)) as l from {clauses} as x))"
    terms = f"select bucket, idx, w as term from {tokens} t1 union all select bucket, idx, w || ' ' || after from (select bucket, idx, w, lead(w) over (partition by bucket, idx order by pos) as after from {tokens} t2) where after is not null"
    return f"""
with terms as ({terms}), tf as (select bucket, idx, term, count(*) as tf from terms group by bucket, idx, term
), size as (select bucket, count(*) as n from {clauses} as y group by bucket
), df as (select bucket, term, count(*) as df, sum(tf) as total from tf group by bucket, term
), vocabulary as (
  select bucket, term, df, n, place from (
    select f.bucket, term, df, n, row_number() over (partition by f.bucket order by total desc, term) as place from df f join size s on s.bucket = f.bucket where df <= {MOST_SHARE} * n)
  where place <= {MOST_TERMS}
), raw as (
  select tf.bucket, tf.idx, tf.term, v.place, tf.tf * (ln(cast(1 + n as double) / (1 + df)) + 1) as w from tf join vocabulary v on v.bucket = tf.bucket and v.term = tf.term
)
select bucket, idx, term, cast(place as int) as place, w / sqrt(sum(w * w) over (partition by bucket, idx)) as weight from raw
"""


#: All terms of a list of lists of words: the words, and neighbours of one list.
_PAIRS = "flatten(transform(lists, l -> zip_with(slice(l, 1, greatest(size(l) - 1, 0)), slice(l, 2, greatest(size(l) - 1, 0)), (a, b) -> struct(a, b))))"
_TERMS = f"concat(flatten(lists), transform({_PAIRS}, p -> p.a || ' ' || p.b))"


def _words(clauses: DataFrame, stop: tuple[str, ...] | list[str]) -> DataFrame:
    """(bucket, idx, n, lists) of clauses (bucket, idx, text): the words of each text of a clause; its n rows are one clause."""
    words = ", ".join(map(SPARK.lit, stop)) or "null"
    given = clauses.groupBy("bucket", "idx").agg(F.count("*").alias("n"), F.collect_list("text").alias("texts"))
    kept = f"w -> coalesce(w not in ({words}), true)"
    return given.select("bucket", "idx", "n", F.expr(f"transform(texts, t -> filter(regexp_extract_all(lower(t), '[\\\\p{{L}}\\\\p{{N}}_]{{2,}}', 0), {kept}))").alias("lists"))


def vocabulary(clauses: DataFrame, stop: tuple[str, ...] | list[str] = STOP_WORDS, words: DataFrame | None = None) -> DataFrame:
    """(bucket, term, place, df, n) of clauses (bucket, idx, text): the terms that count in a bucket of n clauses, df of which hold the term.

    Words come first: where MOST_TERMS of them may count, no term below the last one's total does, and a
    pair is no more frequent than its words. So pairs are counted only where both words reach it, which is exact.
    """
    words = materialize(_words(clauses, stop), "words") if words is None else words
    size = "(select bucket, sum(n) as n from <words> group by bucket)"
    single = materialize(
        run(
            f"""
with counted as (
  select bucket, x.term, sum(x.tf) as total, sum(x.df) as df
  from (select bucket, explode(concat(transform(flatten(lists), t -> struct(t as term, 1 as tf, 0 as df)), transform(array_distinct(flatten(lists)), t -> struct(t as term, 0 as tf, 1 as df)))) as x from <words>) group by bucket, x.term
)
select c.bucket, term, total, df, n from counted c join {size} s on s.bucket = c.bucket""",
            words=words,
        ),
        "single",
    )
    last = f"(select bucket, if(count(*) = {MOST_TERMS}, min(total), 0) as last from (select bucket, total, row_number() over (partition by bucket order by total desc, term) as place from <single> where df <= {MOST_SHARE} * n) where place <= {MOST_TERMS} group by bucket)"
    frequent = materialize(run(f"select x.* from <single> x left join {last} t on t.bucket = x.bucket where total >= coalesce(last, 0)", single=single), "frequent")
    return run(
        f"""
with pairs as (
  select /*+ broadcast(f), broadcast(g) */ p.bucket, p.idx, f.n, x.a || ' ' || x.b as term
  from (select bucket, idx, explode({_PAIRS}) as x from <words>) p join <frequent> f on f.bucket = p.bucket and f.term = x.a join <frequent> g on g.bucket = p.bucket and g.term = x.b
), counted as (
  select bucket, term, total, df, n from <frequent> union all
  select bucket, term, sum(tf), count(*), n from (select bucket, idx, n, term, count(*) as tf from pairs group by bucket, idx, n, term) group by bucket, n, term
)
select bucket, term, place, df, n from (select *, row_number() over (partition by bucket order by total desc, term) as place from counted where df <= {MOST_SHARE} * n) where place <= {MOST_TERMS}""",
        words=words,
        frequent=frequent,
    )


def tfidf(clauses: DataFrame, stop: tuple[str, ...] | list[str] = STOP_WORDS) -> DataFrame:
    """(bucket, idx, term, place, weight) of clauses (bucket, idx, text); place numbers a bucket's terms from 1.

    Terms are words of two letters or digits or more without stop words, and neighbouring pairs of those left.
    A term in more than MOST_SHARE of a bucket is out; the MOST_TERMS most frequent stay, ties by the
    alphabet. idf = ln((1 + n) / (1 + df)) + 1; weights have unit length within a clause. A bucket
    without terms gives no rows. The vocabulary is written once; it is bounded (buckets are pairs of fixed
    values), so clauses meet it where they are, and only terms that count are shuffled. The length is
    summed in order of place, so clauses of the same terms have the same weights to the last bit.
    """
    words = materialize(_words(clauses, stop), "words")
    known = materialize(vocabulary(clauses, stop, words), "vocabulary")
    return run(
        f"""
with hits as (
  select /*+ broadcast(v) */ t.bucket, t.idx, v.place, v.df, v.n from (select bucket, idx, explode({_TERMS}) as term from <words>) t join <known> v on v.bucket = t.bucket and v.term = t.term distribute by bucket, idx
), raw as (
  select bucket, idx, array_sort(collect_list(struct(place, tf * (ln(cast(1 + n as double) / (1 + df)) + 1) as w))) as raw
  from (select bucket, idx, place, df, n, count(*) as tf from hits group by bucket, idx, place, df, n) group by bucket, idx
), unit as (
  select bucket, idx, inline(transform(raw, x -> struct(x.place as place, x.w / length as weight))) from (select *, sqrt(aggregate(raw, 0D, (a, x) -> a + x.w * x.w)) as length from raw)
)
select /*+ broadcast(v) */ u.bucket, u.idx, v.term, cast(u.place as int) as place, u.weight from unit u join <known> v on v.bucket = u.bucket and v.place = u.place""",
        words=words,
        known=known,
    )


def edges_sql(weights: str, threshold: float) -> str:
    """Pairs a < b of a bucket with cosine (rounded to nine places) of at least the threshold."""
    return f"select bucket, a, b, sim from (select x.bucket, x.idx as a, y.idx as b, round(sum(x.weight * y.weight), 9) as sim from {weights} x join {weights} y on y.bucket = x.bucket and y.term = x.term and x.idx < y.idx group by x.bucket, x.idx, y.idx) where sim >= {threshold}"


#: A bucket's blocks where there are enough clauses, a block's greatest and least number, rows that are multiplied at once. Similarities are rounded to nine places, half of the last up.
PAIR_BLOCKS, PAIR_BLOCK, LEAST_BLOCK, PAIR_ROWS, HALF = 8, 8192, 2048, 256, 5e-10
#: More than single precision may be off.
NEAR = 1e-4


def vectors(weights: DataFrame) -> DataFrame:
    """(bucket, idx, places, weights): a row for each clause of weights, in order of place."""
    both = weights.groupBy("bucket", "idx").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("x"))
    return both.select("bucket", "idx", F.col("x.place").alias("places"), F.col("x.weight").alias("weights"))


class Side:
    """A block's clauses: ids, a matrix of their vectors, and further columns by name."""

    def __init__(self, t: pa.Table):
        self.columns = {c: t[c].to_numpy() for c in t.column_names if c not in ("places", "weights")}
        self.ids = self.columns["idx"]
        self.m = np.zeros((len(t), MOST_TERMS))
        at = np.repeat(np.arange(len(t)), pc.list_value_length(t["places"]).to_numpy())
        self.m[at, pc.list_flatten(t["places"]).to_numpy() - 1] = pc.list_flatten(t["weights"]).to_numpy()


def bucket_pairs(vectors: DataFrame, reduce: Callable[[Side, Side], Iterator[dict]], schema: str, across: bool = True) -> DataFrame:
    """What reduce(side, other) gives, as columns, for every two blocks of a bucket, and the bucket; a block by itself is both sides.

    A bucket has at most MOST_TERMS terms, so a block's vectors are a small matrix, and the cosines of
    two blocks one product of them; a join on terms would meet each pair once for each common term.
    Blocks grow with the bucket up to PAIR_BLOCK, so a vector is sent to some n / PAIR_BLOCK tasks. What
    reduce gives should be short: an edge list, a spanning forest or counts. Without `across`, blocks
    only meet themselves.
    """
    size = F.least(F.lit(PAIR_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.count("*") / PAIR_BLOCKS)))
    many = vectors.groupBy("bucket").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    many = materialize(many.select("bucket", "blocks", F.monotonically_increasing_id().alias("no")), "buckets")
    tasks = many.agg(F.sum(F.expr("blocks * (blocks + 1L) div 2" if across else "blocks"))).first()[0]
    dealt = vectors.join(many, "bucket").withColumn("own", F.pmod(F.xxhash64("idx"), "blocks").cast("int")).drop("bucket")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if across else F.col("own")).drop("blocks")
    dealt = dealt.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("other")
    types = dict(x.rsplit(" ", 1) for x in schema.split(", "))
    made = pa.schema([("no", pa.int64()), *((c, {"long": pa.int64(), "double": pa.float64()}[k]) for c, k in types.items())])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, bi, bj = (x.as_py() for x in key)
        t = pa.Table.from_batches(list(batches)).drop_columns(["no", "bi", "bj"])
        first = Side(t.filter(pc.equal(t["own"], bi)))
        other = first if bi == bj else Side(t.filter(pc.equal(t["own"], bj)))
        for x in reduce(first, other):
            n = len(next(iter(x.values())))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, no)), *(pa.array(x[c], made.field(c).type) for c in types)], schema=made)

    # tasks of their own, since little data is much work here and would be put together
    met = dealt.repartition(max(1, min(tasks or 1, 2000)), "no", "bi", "bj").groupBy("no", "bi", "bj").applyInArrow(run, f"no long, {schema}")
    return met.join(F.broadcast(many.select("no", "bucket")), "no").drop("no")


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosines of rows i of x and rows j of y, to nine places."""
    out = np.empty(len(i))
    for k in range(0, len(i), 2048):
        out[k : k + 2048] = np.einsum("ij,ij->i", x[i[k : k + 2048]], y[j[k : k + 2048]])
    return np.round(out, 9)


def similarity_edges(weights: DataFrame, threshold: float) -> DataFrame:
    """The pairs of edges_sql."""

    def edges(one: Side, other: Side) -> Iterator[dict]:
        for at in range(0, len(one.ids), PAIR_ROWS):
            sim = one.m[at : at + PAIR_ROWS] @ other.m.T
            i, j = np.nonzero(sim >= threshold - HALF)
            if one is other:
                i, j = i[j > i + at], j[j > i + at]
            a, b = one.ids[i + at], other.ids[j]
            yield {"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": np.round(sim[i, j], 9)}

    return bucket_pairs(vectors(weights), edges, "a long, b long, sim double").select("bucket", "a", "b", "sim")


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of nodes i, j that join two trees of root, one after the other; root is brought up to date."""
    apart = root[i] != root[j]
    x, y = i[apart], j[apart]
    up: dict[int, int] = {}
    links = []
    for u, v, s, t in zip(x.tolist(), y.tolist(), root[x].tolist(), root[y].tolist(), strict=True):
        while s in up:
            s = up[s]
        while t in up:
            t = up[t]
        if s != t:
            up[max(s, t)] = min(s, t)
            links.append((u, v))
    if up:
        root[list(up)] = list(up.values())
        while (root != root[root]).any():
            root[:] = root[root]
    return links


def _forest(one: Side, other: Side, root: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of at least `least` between the nodes of one and (after them) of other that join what root leaves apart.

    Rows of the largest tree only meet columns outside it, so what is linked already is not compared.
    """
    begin = 0 if one is other else len(one.ids)
    x = one.m.astype(np.float32)
    y = x if one is other else other.m.astype(np.float32)
    links = []
    for at in range(0, len(x), PAIR_ROWS):
        rows = np.arange(at, min(at + PAIR_ROWS, len(x)))
        large = root[rows] == np.bincount(root).argmax()
        outside = np.flatnonzero(root[begin:] != root[rows[large][0]]) if large.any() else rows[:0]
        for mine, columns in ((rows[large], outside), (rows[~large], np.arange(len(y)))):
            if not len(mine) or not len(columns):
                continue
            sim = x[mine] @ (y if len(columns) == len(y) else y[columns]).T
            every = np.nonzero(sim >= least - NEAR)
            for k in range(0, len(every[0]), LINKS_AT_ONCE):
                i, j = every[0][k : k + LINKS_AT_ONCE], every[1][k : k + LINKS_AT_ONCE]
                apart = root[mine[i]] != root[columns[j] + begin]
                i, j = i[apart], j[apart]
                # single precision is exact enough but for those at the threshold
                sure = sim[i, j] >= least + NEAR
                sure[~sure] = exact(one.m, other.m, mine[i[~sure]], columns[j[~sure]]) >= least
                links += _joined(root, mine[i[sure]], columns[j[sure]] + begin)
    return links


def bucket_links(vectors: DataFrame) -> DataFrame:
    """(a, b): links that have the components of all pairs of a bucket with cosine of at least `least`, a further column that a bucket has one value of.

    Each block finds its own trees first; then every two blocks meet with these, and only look for what joins them.
    """

    def inside(one: Side, _: Side) -> Iterator[dict]:
        root = np.arange(len(one.ids))
        links = np.array(_forest(one, one, root, one.columns["least"][0]), np.int64).reshape(-1, 2)
        none = np.full(len(links), None)
        yield {"a": one.ids, "b": np.full(len(root), None), "tree": one.ids[root]}
        yield {"a": one.ids[links[:, 0]], "b": one.ids[links[:, 1]], "tree": none}

    def between(one: Side, other: Side) -> Iterator[dict]:
        if one is other:
            return
        _, first, root = np.unique(np.concatenate([one.columns["tree"], other.columns["tree"]]), return_index=True, return_inverse=True)
        links = np.array(_forest(one, other, first[root], one.columns["least"][0]), np.int64).reshape(-1, 2)
        yield {"a": one.ids[links[:, 0]], "b": other.ids[links[:, 1] - len(one.ids)]}

    trees = materialize(bucket_pairs(vectors, inside, "a long, b long, tree long", across=False), "trees")
    own = trees.where("tree is not null").select("bucket", F.col("a").alias("idx"), "tree")
    links = bucket_pairs(vectors.join(own, ["bucket", "idx"]), between, "a long, b long")
    return trees.where("tree is null").select("a", "b").unionByName(links.select("a", "b"))


def linking_edges(weights: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that have the components of all pairs above the threshold of their bucket's size."""
    least = F.when(F.col("bucket_size") > LARGE_BUCKET, LARGE).otherwise(F.lit(threshold)).cast("double")
    return bucket_links(materialize(vectors(weights).join(sizes.select("bucket", least.alias("least")), "bucket"), "vectors"))


def staged_offers(vectors: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, sim, core) and (a, b, sim) for settled_stages: the best that each block of members with a core offers to a loose one, and the pairs of loose ones, both ways.

    Pairs of members that both have a core, by far the most, are neither compared nor written.
    """

    def offers(ids: np.ndarray, loose: np.ndarray, held: np.ndarray, cores: np.ndarray) -> Iterator[dict]:
        low = held.astype(np.float32)
        for at in range(0, len(ids) if len(cores) else 0, PAIR_ROWS):
            some = loose[at : at + PAIR_ROWS]
            sim = some.astype(np.float32) @ low.T
            i, j = np.nonzero(sim >= np.maximum(sim.max(axis=1, keepdims=True) - 2 * NEAR, ATTACH - NEAR))
            sim = exact(some, held, i, j)
            order = np.lexsort((cores[j], -sim, i))
            best = order[np.unique(i[order], return_index=True)[1]]
            best = best[sim[best] >= ATTACH]
            yield {"a": ids[at + i[best]], "b": np.full(len(best), None), "sim": sim[best], "core": cores[j[best]]}

    def met(one: Side, other: Side) -> Iterator[dict]:
        free, bare = (np.isnan(x.columns["core"].astype(float)) for x in (one, other))
        yield from offers(one.ids[free], one.m[free], other.m[~bare], other.columns["core"][~bare].astype(np.int64))
        if one is not other:
            yield from offers(other.ids[bare], other.m[bare], one.m[~free], one.columns["core"][~free].astype(np.int64))
        ids, m = one.ids[free], one.m[free]
        others, n = other.ids[bare], other.m[bare]
        for at in range(0, len(ids), PAIR_ROWS):
            sim = m[at : at + PAIR_ROWS] @ n.T
            i, j = np.nonzero(sim >= ATTACH - HALF)
            if one is other:
                i, j = i[j > i + at], j[j > i + at]
            yield {"a": ids[i + at], "b": others[j], "sim": np.round(sim[i, j], 9), "core": np.full(len(i), None)}

    given = vectors.join(state.select(F.col("node").alias("idx"), "core"), "idx")
    found = materialize(bucket_pairs(given, met, "a long, b long, sim double, core long"), "offers")
    pairs = found.where("b is not null").select("a", "b", "sim")
    return found.where("b is null").select("a", "sim", "core"), pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def similarity_counts(clauses: DataFrame, weights: DataFrame, places: int = 6) -> DataFrame:
    """(bucket, sim, n): how many pairs of a bucket's clauses (bucket, idx) have each similarity, rounded.

    Clauses without terms are similar to none, so their pairs count at 0. A bucket has at most
    10 ** places + 1 rows, however many pairs it has.
    """

    def count(one: Side, other: Side) -> Iterator[dict]:
        n = np.zeros(10**places + 2, np.int64)
        for at in range(0, len(one.ids), PAIR_ROWS):  # some rows at a time: they are binned, not sorted, and little is made beside the block
            sim = one.m[at : at + PAIR_ROWS] @ other.m.T
            sim = sim[np.triu(np.ones(sim.shape, bool), at + 1)] if one is other else sim.ravel()
            value = np.round(np.round(sim, 9) + 1e-10, places)  # ties of nine places go up
            n += np.bincount(np.rint(value * 10**places).astype(np.int64), minlength=len(n))
        at = np.flatnonzero(n)
        yield {"sim": np.round(at / 10**places, places), "n": n[at]}

    counted = bucket_pairs(vectors(weights), count, "sim double, n long").select("bucket", "sim", "n")
    of = lambda df, name: df.groupBy("bucket").agg((F.count_distinct("idx") * (F.count_distinct("idx") - 1) / 2).cast("long").alias(name))
    rest = of(clauses, "every").join(of(weights, "met"), "bucket", "left").select("bucket", F.lit(0.0).alias("sim"), (F.col("every") - F.coalesce("met", F.lit(0))).alias("n"))
    return counted.unionByName(rest).groupBy("bucket", "sim").agg(F.sum("n").alias("n")).where("n > 0")


def embedded(rows: DataFrame, text: str, embed: Callable[[pd.Series], pd.Series], out: str = "vector") -> DataFrame:
    """T4: rows plus the vector that an injected function gives to each text; it sees a batch of texts at once."""
    return rows.withColumn(out, F.pandas_udf(embed, "array<double>")(text))


#: Blocks of dense vectors where there are enough of them, a block's greatest and least number, rows that are multiplied at once, and pairs that are looked at at once.
DENSE_BLOCKS, MOST_DENSE, LEAST_DENSE, DENSE_ROWS, LINKS_AT_ONCE = 16, 8192, 1024, 256, 20_000


def _dense_pairs(vectors: DataFrame, ident: str, vector: str, threshold: float, reduce: Callable[[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], pd.DataFrame], schema: str, block: int) -> DataFrame:
    """reduce(ids, pairs) of every two blocks of vectors; pairs are places in ids and cosines, LINKS_AT_ONCE of them at most.

    Pairs are those of different ids with cosine, to nine places, of at least the threshold, each once. Blocks grow
    with the table up to MOST_DENSE, so a vector is sent to some n / MOST_DENSE tasks.
    """
    n = vectors.count()
    n = max(1, -(-n // (block or min(MOST_DENSE, max(LEAST_DENSE, -(-n // DENSE_BLOCKS))))))
    dealt = vectors.select(F.col(ident).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(ident), F.lit(n)).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")})

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("own", ignore_index=True)
        m = np.array(rows["v"].tolist(), np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids = rows["id"].to_numpy()
        first = int((rows["own"] == key[0]).sum())
        begin = 0 if key[0] == key[1] else first
        low = m.astype(np.float32)
        held = np.empty((min(DENSE_ROWS, first), len(m) - begin), np.float32)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for at in range(0, first, DENSE_ROWS):
                some = low[at : min(at + DENSE_ROWS, first)]
                # single precision is far closer than a thousandth; the exact cosine is taken where it may count
                every = np.nonzero(np.matmul(some, low[begin:].T, out=held[: len(some)]) >= threshold - 1e-3)
                for k in range(0, len(every[0]), LINKS_AT_ONCE):
                    i, j = every[0][k : k + LINKS_AT_ONCE] + at, every[1][k : k + LINKS_AT_ONCE] + begin
                    sim = np.round(np.einsum("ij,ij->i", m[i], m[j]), 9)
                    hit = (sim >= threshold) & ((ids[i] < ids[j]) if begin == 0 else True)
                    yield i[hit], j[hit], sim[hit]

        return reduce(ids, pairs())

    # tasks of their own, since little data is much work here and would be put together
    return dealt.select("id", "v", "own", "bi", "bj").repartition(min(n * (n + 1) // 2, 2000), "bi", "bj").groupBy("bi", "bj").applyInPandas(run, schema)


def dense_edges(vectors: DataFrame, ident: str, vector: str, threshold: float, block: int = 0) -> DataFrame:
    """T4, T5: pairs a < b of dense vectors with cosine of at least the threshold.

    Vectors are dealt into blocks; every two blocks meet in one task, which multiplies them.
    """

    def edges(ids: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "sim": sim}) for i, j, sim in pairs] or [pd.DataFrame({"a": [], "b": [], "sim": []})])

    return _dense_pairs(vectors, ident, vector, threshold, edges, "a long, b long, sim double", block)


def dense_links(vectors: DataFrame, ident: str, vector: str, threshold: float, block: int = 0) -> DataFrame:
    """(a, b): a spanning forest, in each two blocks, of the pairs of dense_edges; it has their components."""

    def forest(ids: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        root = np.arange(len(ids))
        links = []
        for i, j, _ in pairs:
            links += _joined(root, i, j)
        ends = ids[np.array(links, np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return _dense_pairs(vectors, ident, vector, threshold, forest, "a long, b long", block)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the threshold graph; clauses without an edge have no row."""
    return connected_components(edges)


def categories_sql(clauses: str, d: Spark = SPARK) -> str:
    """Clauses with category, requirement_type and bucket (both)."""
    rows = f"(select clause_idx, standard_name, clause_number, text, {r.category('text', d)} as category, {r.requirement_type('clause_number', 'text', d)} as requirement_type from {clauses} as x)"
    return f"select *, category || '/' || requirement_type as bucket from {rows} as y"


def buckets_sql(d: Spark, clauses: str) -> str:
    """categories_sql with each bucket's size and first index, which are aggregated (a row for each bucket) and joined."""
    return f"""
with placed as ({categories_sql(clauses, d)}), sizes as (select bucket as b, count(*) as bucket_size, min(clause_idx) as bucket_first from placed group by bucket)
select clause_idx, standard_name, clause_number, text, category, requirement_type, bucket, bucket_size, bucket_first from placed join sizes on sizes.b = placed.bucket
"""


def grouped_clauses(clauses: DataFrame, threshold: float = BASE, staged: bool = True) -> DataFrame:
    """(group_id, clause_idx, category, requirement_type): groups of similar clauses of two standards or more.

    Buckets of one clause have no groups; a bucket of two clauses from two standards is one group
    whatever their similarity; buckets above LARGE_BUCKET use the threshold LARGE. Components of
    STAGED_SIZE or more are split in stages. Group numbers follow the bucket's first clause, then the
    group's.
    """
    placed = materialize(run(categories_sql("<clauses>"), clauses=clauses), "categories")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("bucket_size"), F.min("clause_idx").alias("bucket_first"))
    b = placed.join(sizes, "bucket")
    larger = b.where("bucket_size > 2").select("bucket", F.col("clause_idx").alias("idx"), "text", "bucket_size")
    weights = materialize(tfidf(larger), "tfidf")
    found = connected_components(linking_edges(weights, sizes, threshold))
    if staged:
        large = found.groupBy("component").agg(F.count("*").alias("n")).where(f"n >= {STAGED_SIZE}").select("component")
        inside = materialize(found.join(large, "component").select("component", "node"), "inside")
        # all pairs of a bucket at ATTACH lie within its components
        held = materialize(vectors(weights).join(inside, F.col("idx") == inside.node, "left_semi").withColumn("least", F.lit(CORE)), "vectors")
        cores = connected_components(bucket_links(held)).select("node", F.col("component").alias("core"))
        state = materialize(inside.select("node").join(cores, "node", "left"), "state")
        split = settled_stages(inside, state, *staged_offers(held.drop("least"), state))
        found = found.join(split.select("node", "cluster"), "node", "left").select("node", F.coalesce("cluster", "component").alias("component"))
    pairs = b.where("bucket_size = 2").select(F.col("clause_idx").alias("node"), F.col("bucket_first").alias("component"))
    members = found.select("node", "component").unionByName(pairs).join(b.drop("text"), F.col("node") == b.clause_idx)
    members = materialize(members.select("component", "bucket_first", "clause_idx", "standard_name", "category", "requirement_type"), "members")
    # numbers are given to the groups, of which each bucket has few, not to their members
    kept = members.groupBy("component").agg(F.min("bucket_first").alias("bucket_first"), F.count("*").alias("n"), F.min("standard_name").alias("s1"), F.max("standard_name").alias("s2")).where("n >= 2 and s1 <> s2")
    kept = numbered(kept.select("component", "bucket_first"), ["bucket_first", "component"], "group_id")
    return members.join(kept, "component").select("group_id", "clause_idx", "category", "requirement_type")


def near_duplicates(rows: DataFrame, threshold: float = 0.95, scope: str | None = None) -> DataFrame:
    """(id, original) of rows (id, text), compared stripped and in lower case; empty texts are kept.

    With a scope (a column: the document that rows come from), only rows of one scope are compared, as
    one upload at a time would be. Equal texts of a scope are settled by an aggregate; only one row of
    each is compared with others.
    """
    s = rows.select("id", F.coalesce(F.col(scope), F.lit(-1)).alias("scope") if scope else F.lit(0).alias("scope"), F.lower(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("s"))
    first = materialize(s.where("s <> ''").groupBy("scope", "s").agg(F.min("id").alias("id")), "texts")
    settled = greedy_near(first, threshold)
    own = s.join(first.select("scope", "s", F.col("id").alias("rep")), ["scope", "s"], "left").join(settled.select(F.col("id").alias("rep"), "original"), "rep", "left")
    return own.select("id", F.when(F.col("rep").isNull(), None).when(F.col("rep") != F.col("id"), F.coalesce("original", "rep")).otherwise(F.col("original")).alias("original"))


def clause_duplicates(rows: DataFrame, threshold: float = 0.90) -> DataFrame:
    """(id, original) of rows (id, clause, text): near an earlier kept row of the same clause (ratio above the threshold).

    Rows without clause or text are dropped from the result. Equal texts of a clause are settled by an
    aggregate; only one row of each is compared with others.
    """
    given = rows.where("clause <> '' and text <> ''").select("id", F.col("clause").alias("scope"), F.col("text").alias("s"))
    first = materialize(given.groupBy("scope", "s").agg(F.min("id").alias("id")), "texts")
    settled = greedy_near(first, threshold, swapped=True, strict=True)
    own = given.join(first.select("scope", "s", F.col("id").alias("rep")), ["scope", "s"]).join(settled.select(F.col("id").alias("rep"), "original"), "rep")
    return own.select("id", F.when(F.col("rep") != F.col("id"), F.coalesce("original", "rep")).otherwise(F.col("original")).alias("original"))
