"""Jobs that SQL can't check, against plain sequential versions on small tables."""

import json
import math
import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseworks.functions import models, python as p
from clauseworks.operators import coredelta, extraction, nearness, ordering
from clauseworks.operators import similarity as s
from clauseworks.plans import fixtures, jobs, queries
from clauseworks.runtime import materialize
from clauseworks.sources import sinks, tables


@pytest.fixture(scope="module")
def clauses(spark, sf):
    return [r.asDict() for r in fixtures.fx_clauses(spark, sf).orderBy("clause_idx").collect()]


def greedy(rows, threshold, swapped=False, strict=False):
    """id -> the first kept row of the same scope that it is near, or None."""
    kept, out = defaultdict(list), {}
    for scope, i, t in rows:
        hit = None
        for j, k in kept[scope] if t else []:
            found = SequenceMatcher(None, *((k, t) if swapped else (t, k))).ratio()
            if found > threshold if strict else found >= threshold:
                hit = j
                break
        out[i] = hit
        if hit is None and t:
            kept[scope].append((i, t))
    return out


def test_whole_texts_are_in_the_fixtures(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lines = fixtures.fx_lines(spark, sf).orderBy("lineno").collect()
    for i, t in texts.items():
        assert "\n".join(r.t for r in lines if r.doc_id == i and r.lineno % 2 == 0) == t
    assert fixtures.fx_clauses(spark, sf).selectExpr("count(distinct clause_idx) = count(*)").first()[0]


def test_near_duplicates_of_a_document(spark, sf, clauses):
    got = {r.id: r.original for r in jobs.near_duplicates(spark, sf).collect()}
    strip = lambda t: re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", t).lower()
    assert got == greedy([(r["doc_id"], r["clause_idx"], strip(r["text"])) for r in clauses], 0.95)


def test_duplicates_of_a_clause(spark, sf, clauses):
    got = {r.id: r.original for r in jobs.clause_duplicates(spark, sf).collect()}
    rows = [((r["doc_id"], r["clause_number"]), r["clause_idx"], r["text"]) for r in clauses]
    assert got == greedy(rows, 0.90, swapped=True, strict=True)


def test_near_by_ratio_finds_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 40))) for _ in range(12)]
    texts = base + [t[:k] + rng.choice("abx") + t[k + 1 :] for t in base for k in [rng.randrange(len(t))]] + [t + "a" for t in base] + base[:3]
    rows = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(texts)], "scope int, id int, s string")
    got = {(r.kept, r.new) for r in nearness.near_by_ratio(rows, 0.9).collect()}
    assert got == {(a, b) for a, b in combinations(range(len(texts)), 2) if a % 2 == b % 2 and SequenceMatcher(None, texts[b], texts[a]).ratio() >= 0.9}


def small_weights(spark, n=60):
    rng = random.Random(5)
    terms = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(f"b{i % 2}", i, " ".join(rng.choices(terms, k=rng.randint(0, 4)))) for i in range(n)]
    given = spark.createDataFrame(rows, "bucket string, idx long, text string")
    return given, s.tfidf(given)


@pytest.mark.parametrize("block", [2048, 7])
def test_pairs_of_a_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(s, "PAIR_BLOCK", block)
    given, weights = small_weights(spark)
    vectors = defaultdict(dict)
    for r in weights.collect():
        vectors[r.bucket, r.idx][r.term] = r.weight
    dot = lambda a, b: round(sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items()), 9)
    ids = sorted((r.bucket, r.idx) for r in given.collect())
    sims = {(a, b): dot(a, b) for a, b in combinations(ids, 2) if a[0] == b[0]}
    got = {((r.bucket, r.a), (r.bucket, r.b)): r.sim for r in s.similarity_edges(weights, 0.4).collect()}
    assert got.keys() == {k for k, v in sims.items() if v >= 0.4}
    assert all(abs(got[k] - sims[k]) < 1e-8 for k in got)
    counted = {(r.bucket, round(r.sim, 6)): r.n for r in s.similarity_counts(given.select("bucket", "idx"), weights).collect()}
    assert counted == Counter((a[0], round(v, 6)) for (a, _), v in sims.items())
    sizes = spark.createDataFrame([("b0", 30), ("b1", 300)], "bucket string, bucket_size long")
    linked = defaultdict(set)
    for r in s.linking_edges(weights, sizes, 0.35).collect():
        linked[r.a].add(r.b)
        linked[r.b].add(r.a)
        pair = tuple(sorted(k for k in ids if k[1] in (r.a, r.b)))
        assert sims[pair] >= (0.35 if pair[0][0] == "b0" else 0.45)

    def reach(edges):
        out = {}
        for x in sorted(edges):
            queue = [] if x in out else [x]
            while queue:
                y = queue.pop()
                if y not in out:
                    out[y] = x
                    queue += edges[y]
        return out

    every = defaultdict(set)
    for (a, b), v in sims.items():
        if v >= (0.35 if a[0] == "b0" else 0.45):
            every[a[1]].add(b[1])
            every[b[1]].add(a[1])
    assert reach(linked) == reach(every)


@pytest.mark.parametrize("block", [0, 40])
def test_links_of_dense_vectors_are_few(spark, block):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in centres[i % 5]]) for i in range(150)] + [(900, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    want = {(a, b) for (a, x), (b, y) in combinations(rows[:150], 2) if round(sum(p * q for p, q in zip(x, y, strict=True)) / norm(x) / norm(y), 9) >= 0.9}
    assert {(r.a, r.b) for r in s.dense_edges(vectors, "id", "v", 0.9, block).collect()} == want
    links = s.dense_links(vectors, "id", "v", 0.9, block)
    few = {tuple(sorted((r.a, r.b))) for r in links.collect()}
    assert few <= want and len(few) < len(want) / 2
    found = lambda e: {(r.node, r.component) for r in s.components(e).collect()}
    assert found(links) == found(spark.createDataFrame(sorted(want), "a long, b long"))


def test_numbered(spark):
    rows = [(x,) for x in random.Random(1).sample(range(10**6), 500)]
    got = ordering.numbered(spark.createDataFrame(rows, "x long").repartition(5), ["x"], "n").collect()
    assert {r.x: r.n for r in got} == {x: i for i, (x,) in enumerate(sorted(rows))}
    assert ordering.numbered(spark.createDataFrame([], "x long"), ["x"], "n").count() == 0


def test_core_groups_pass_three_gates(spark):
    text = "battery warning shall include assembly maintenance 25 °C"
    rows = [
        (1, "t", 1, text, "EN 1", "1"), (1, "t", 2, text + " paper", "EN 2", "2"),
        (3, "t", 3, "the of and to battery", "EN 1", "1"), (3, "t", 4, "the of and to charger", "EN 1", "2"),
        (5, "t", 5, "battery warning shall include assembly maintenance", "EN 1", "1"), (5, "t", 6, "battery warning shall include assembly maintenance qqq www eee rrr ttt yyy uuu iii ooo ppp aaa sss ddd fff", "EN 1", "2"),
    ]
    given = spark.createDataFrame([(*r[:4], *r[4:], "°" in r[3], False, "warning" in r[3]) for r in rows], "seed long, topic string, id long, text string, standard string, clause string, temperature boolean, measurement boolean, warning boolean")
    got = {r.seed: r for r in coredelta.core_groups(given).collect()}
    assert got[1].core == "Instructions shall assembly instructions maintenance procedures battery specifications safety warnings including necessary details for safe use."
    assert got[1].accepted and got[1].least_ratio == pytest.approx(4 / 9)
    assert got[1].deltas == "EN 1 1: Temperature: 25 °C; Uses WARNING\nEN 2 2: Temperature: 25 °C; Paper format required; Uses WARNING"
    assert got[3].core == "" and not got[3].accepted
    assert not got[5].accepted and got[5].least_ratio < 0.35


def test_topic_splits_walk_in_order(spark, sf):
    rows = [r.asDict() for r in jobs._topics(spark, sf).orderBy("id").collect()]
    groups = defaultdict(list)
    for r in rows:
        if r["topic"] in ("battery_charging", "symbols", "maintenance"):
            groups[r["topic"]].append(r)
    expected = set()
    for items in groups.values():
        free = list(items)
        while free:
            seed, rest, members = free[0], [], [free[0]]
            for x in free[1:]:
                if len(members) < coredelta.MOST_MEMBERS and coredelta.hybrid_similarity(seed, x) >= coredelta.LEAST_SIMILARITY:
                    members.append(x)
                else:
                    rest.append(x)
            if len(members) > 1:
                expected |= {(m["id"], seed["id"]) for m in members}
            free = rest
    got = {(r.id, r.seed) for r in jobs.topic_splits(spark, sf).collect() if r.topic in groups}
    assert got == expected


def upload_brute(chunks, standards):
    """(doc, text) of the rows left, and per document counts, one chunk at a time."""
    left, stats = [], {}
    for doc in sorted({c.doc_id for c in chunks}):
        own = sorted((c for c in chunks if c.doc_id == doc), key=lambda c: (c.chunk, c.part))
        texts = [c.content.rstrip("\n") for c in own]
        given = [t for t in texts if t.replace(" ", "")]
        kept = [i for i, x in greedy([(0, i, t.strip(" \t\n\x0b\f\r").lower()) for i, t in enumerate(given)], 0.95).items() if x is None]
        left += [(doc, standards[doc], given[i]) for i in kept]
        stats[doc] = (len(own), math.ceil(len(own) / 30), len(given), len(given) - len(kept), len(kept))
    return left, stats


def test_upload_path(spark, sf):
    from clauseworks.operators import segments

    chunks = segments.bounded_segments(fixtures.fx_lines(spark, sf), "all").collect()
    standards = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    left, stats = upload_brute(chunks, standards)
    assert sorted((r.doc_id, r.standard, r.text) for r in jobs.uploads(spark, sf).collect()) == sorted(left)
    assert {r.doc_id: (r.chunks, r.batches, r.original_count, r.duplicates_removed, r.rows) for r in jobs.upload_stats(spark, sf).collect()} == stats


def test_extraction_asks_only_for_what_the_cache_lacks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, k, 0, f"{k}.1", f"clause text {k % 40}") for k in range(70)], "doc_id long, chunk int, part int, clause_number string, content string")
    cached = spark.createDataFrame([(x, "9", "from the cache") for x in [__import__("hashlib").md5(f"all:clause text {k}".encode()).hexdigest() for k in range(10)]], "key string, clause string, text string")
    log = tmp_path / "prompts"

    def call(prompt):
        with log.open("a") as f:
            f.write(str(prompt.count("<<")) + "\n")
        return extraction.echo_clauses(prompt)

    rows, fresh = extraction.extract_clauses(chunks, call, cached)
    got = rows.collect()
    assert len(got) == 70 and sum(r.cached for r in got) == 20
    assert {r.text for r in got if r.cached} == {"from the cache"}
    assert fresh.count() == 30
    assert sorted(log.read_text().split()) == ["20", "30"]

    def broken(prompt):
        raise ValueError("no")

    for reply in (broken, lambda prompt: "no json", lambda prompt: '"text"'):
        rows, fresh = extraction.extract_clauses(chunks, reply)
        assert rows.count() == 0 and fresh.count() == 0


def test_chunked_extraction(spark, sf):
    texts = {r.doc_id: r.text for r in jobs._texts(spark, sf).collect()}
    chunks = p.smart_chunks(jobs._texts(spark, sf)).orderBy("doc_id", "chunk_idx").collect()
    assert {c.doc_id for c in chunks} == set(texts)
    given = [(c.doc_id, c.chunk_idx, k, x["clause"].strip(), x["text"].strip(" ")) for c in chunks for k, x in enumerate(json.loads(extraction.numbered_lines("TEXT:\n" + c.chunk)))]
    found = greedy([((x[0], x[3]), i, x[4]) for i, x in enumerate(given)], 0.90, swapped=True, strict=True)
    got = sorted((r.doc_id, r.chunk_idx, r.pos, r.clause, r.text) for r in jobs.chunked_extraction(spark, sf).collect())
    assert got == sorted(x for i, x in enumerate(given) if found[i] is None)


def test_replies_of_one_object_or_an_array(spark):
    rows = spark.createDataFrame([(1, '{"clause": "1", "text": "a"}'), (2, '[{"clause": "2", "text": "b"}, {"text": "c"}]'), (3, "7"), (4, None)], "doc_id long, reply string")
    assert sorted((r.doc_id, r.pos, r.clause, r.text) for r in extraction.requirement_rows(rows).collect() if r.clause) == [(1, 0, "1", "a"), (2, 0, "2", "b")]
    assert extraction.requirement_rows(rows).count() == 3


def test_the_end_of_a_long_document_is_shown_to_the_model(spark):
    docs = spark.createDataFrame([(1, "1.1 first\n" + "word " * 30_000 + "\n9.9 last"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.pos, r.clause, r.text) for r in extraction.whole_documents(docs).orderBy("pos").collect()] == [(1, 0, "1.1", "first"), (1, 1, "9.9", "last")]


def test_consolidation_in_batches(spark, monkeypatch):
    monkeypatch.setattr(extraction, "REQUIREMENTS_PER_CALL", 6)
    rows = [(0, i, "A" if i < 4 else "B", "the same first twenty letters" if i % 2 else f"other {i} of its own kind") for i in range(12)] + [(0, 20, "A", "x"), (1, 30, "A", "y")]
    got = extraction.consolidated(spark.createDataFrame(rows, "scope long, id long, standard string, text string")).collect()
    assert {r.id: r.group_id for r in got} == {**{i: None for _, i, _, _ in rows}, 1: 0, 3: 0, 5: 0}
    assert len(got) == len(rows)


def test_cache_is_read_whatever_is_there(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert tables.read_cache(spark, path, "key string, value string").count() == 0
    for rows in ([("a", "old"), ("b", "old")], [("a", "new")]):
        sinks.save_cache(spark.createDataFrame(rows, "key string, value string"), path)
    assert {r.key: r.value for r in tables.read_cache(spark, path, "key string, value string").collect()} == {"a": "new", "b": "old"}
    (tmp_path / "cache" / "broken.json").write_text('{"key": "c", "val\n')
    assert tables.read_cache(spark, path, "key string, value string").count() == 2


def test_resolution_keeps_the_first(spark, sf, clauses):
    got = {r.id: r.original for r in jobs.greedy_resolution(spark, sf).collect()}
    assert got == {i: x for i, x in greedy([(r["doc_id"], r["clause_idx"], r["text"]) for r in clauses], 0.90).items()}


def test_stand_in_groups_are_of_bounded_documents(spark, sf):
    from clauseworks.functions.dialect import SPARK, run

    groups = run(f"select group_id, max(doc_id) - min(doc_id) as span, count(distinct standard_name) as n from {queries.groups_sql(SPARK, '<clauses>')} as x group by group_id", clauses=fixtures.fx_clauses(spark, sf)).collect()
    assert groups and all(r.span < queries.DOCUMENTS_AT_ONCE and r.n >= 2 for r in groups)
    assert np.isfinite([r.group_id for r in groups]).all()


def test_consolidation_takes_whole_groups_of_the_whole_load(spark, tmp_path, monkeypatch):
    """Groups go over all documents and have any number of clauses; large ones are asked for in parts that lose none."""
    text = "Battery pack voltage shall be stated."
    spark.createDataFrame([(i, text + "\n" + text, "en", f"src{i % 2}", 0) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    given = defaultdict(list)
    for r in spark.sql(s.categories_sql("{c}"), c=fixtures.fx_clauses(spark, str(tmp_path))).collect():
        given[r.bucket].append((r.clause_idx, r.standard_name))
    groups = {min(x)[0]: len(x) for x in given.values() if len({standard for _, standard in x}) > 1}
    assert max(groups.values()) > 100
    got = jobs.consolidation(spark, str(tmp_path)).collect()
    assert {r.group_id: 2 if r.failure else r.clauses for r in got} == groups and len(got) == len(groups)
    monkeypatch.setattr(extraction, "GROUPED_PER_CALL", 4)
    rows = [(7, i, "A", "1", f"t{i}") for i in range(9)] + [(8, 100, "A", "1", "x"), (8, 101, None, "1", "y"), (8, 102, "B", "2", "z")]
    prompts = extraction.group_prompts(spark.createDataFrame(rows, "group_id long, id long, standard string, clause string, text string")).orderBy("group_id", "part").collect()
    assert [(r.group_id, r.part, r.prompt.count("\n")) for r in prompts] == [(7, 0, 3), (7, 1, 3), (7, 2, 3), (8, 0, 2)]
    assert [x for r in prompts if r.group_id == 7 for x in r.prompt.split("\n")[1:]] == [f"A 1: t{i}" for i in range(9)]
    told = spark.createDataFrame([(1, 0, '{"clauses": 3}', None), (1, 1, '{"clauses": 4}', None), (2, 0, '{"clauses": 3}', None), (2, 1, None, "busy"), (2, 2, None, "late")], "group_id long, part long, reply string, failure string")
    assert sorted(tuple(r) for r in extraction.whole_groups(told, "clauses long").collect()) == [(1, 7, None), (2, None, "busy")]


def test_calls_take_bounded_batches(spark):
    rows = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 500000) as prompt")
    asked = models.ask(rows, "prompt", lambda prompt: str(len(prompt)))
    sizes = rows.mapInPandas(lambda batches: (b[["id"]].assign(n=len(b)) for b in batches), "id long, n long").agg({"n": "max"}).first()[0]
    assert sizes * 500000 < 3 * models.BYTES_AT_ONCE
    assert [r.reply for r in asked.select("reply").collect()] == ["500000"] * 40


def test_numbered_within_deals_out_a_key(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 5000).selectExpr("if(id < 4990, 0, id % 3) as k", "-id as x").repartition(5)
        got = ordering.numbered_within(rows, ["k"], ["x"], "n")
        assert "hashpartitioning(k#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and all("__part" in x for x in plan.splitlines() if "SortMergeJoin" in x)
        found = [(r.k, r.x, r.n) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for k in (0, 1, 2):
        xs = sorted(x for key, x, _ in found if key == k)
        assert sorted((n, x) for key, x, n in found if key == k) == list(enumerate(xs))


def test_pairs_are_counted_only_where_both_words_reach_the_last_place(spark, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    chance = random.Random(5)
    rows = [("ab"[i % 2], i // 3 * 2 + i % 2, " ".join(chance.choices([f"w{j}" for j in range(12)] + ["The", "x1 x2"], [2.0**-j for j in range(12)] + [1, 0.2], k=9))) for i in range(240)]
    rows += [("c", 1, "one two"), ("c", 2, "one two three"), ("d", 3, None)]
    db = duckdb.connect()
    db.execute("create table c (bucket varchar, idx bigint, text varchar)")
    db.executemany("insert into c values (?, ?, ?)", [r for r in rows if r[0] != "a" or r[1] % 4])
    given = spark.createDataFrame([r for r in rows if r[0] != "a" or r[1] % 4], "bucket string, idx long, text string").dropDuplicates(["bucket", "idx"])
    kept = given.collect()
    db.execute("delete from c")
    db.executemany("insert into c values (?, ?, ?)", [tuple(r) for r in kept])
    given = spark.createDataFrame(kept, "bucket string, idx long, text string")
    for most in (3, 8, 500):
        monkeypatch.setattr(s, "MOST_TERMS", most)
        want = {(b, i, t, p): w for b, i, t, p, w in db.execute(s.tfidf_sql(queries.DUCK, "c")).fetchall()}
        got = {(r.bucket, r.idx, r.term, r.place): r.weight for r in s.tfidf(given).collect()}
        assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)
        assert {(b, t, p) for b, _, t, p in want} == {(r.bucket, r.term, r.place) for r in s.vocabulary(given).collect()}


def test_counts_of_similarities_with_clauses_without_terms(spark):
    weights = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 2, 1, 0.6), ("a", 2, 2, 0.8), ("a", 3, 2, 1.0)], "bucket string, idx long, place int, weight double")
    given = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4)], "bucket string, idx long")
    assert {(r.sim, r.n) for r in s.similarity_counts(given, weights).collect()} == {(0.6, 1), (0.8, 1), (0.0, 4)}


@pytest.mark.parametrize("block", [8192, 11])
def test_staged_buckets_equal_the_stages_over_all_edges(spark, monkeypatch, block):
    monkeypatch.setattr(s, "PAIR_BLOCK", block)
    chance = random.Random(8)
    rows = []
    for i in range(120):
        place, w = chance.randint(1, 6), chance.choice([0.58, 0.62, 0.66, 0.7, 0.75, 0.8])
        rows += [("ab"[i % 2], i, place, w)] + [("ab"[i % 2], i, place % 6 + 1, w)] * (w < 0.66)
    weights = spark.createDataFrame(rows, "bucket string, idx long, place int, weight double")
    edges = materialize(s.similarity_edges(weights, s.ATTACH), "edges")
    inside = materialize(weights.select(F.expr("if(bucket = 'a', 0L, 1L)").alias("component"), F.col("idx").alias("node")).distinct(), "inside")
    want = {r.node: r.cluster for r in s.staged_clusters(edges.select(F.expr("if(bucket = 'a', 0L, 1L)").alias("component"), "a", "b", "sim"), inside, 2).collect()}
    held = s.vectors(weights)
    links = s.bucket_links(held.withColumn("least", F.lit(s.CORE)))
    state = materialize(inside.select("node").join(s.components(links).select("node", F.col("component").alias("core")), "node", "left"), "state")
    offers, pairs = s.staged_offers(held, state)
    got = {r.node: r.cluster for r in s.settled_stages(inside, state, offers, pairs).collect()}
    assert got == want and len(set(want.values())) > 4
    loose = {r.node for r in state.where("core is null").collect()}
    assert loose and all(r.a in loose and r.b in loose for r in pairs.collect())


def test_links_of_a_bucket_grow_with_its_clauses_not_with_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "PAIR_BLOCK", 10)
    weights = spark.createDataFrame([("a", i, 1, 1.0) for i in range(200)], "bucket string, idx long, place int, weight double")
    sizes = spark.createDataFrame([("a", 200)], "bucket string, bucket_size long")
    links = s.linking_edges(weights, sizes, 0.35)
    assert links.count() < 200 + 20 * 20 and {r.component for r in s.components(links).collect()} == {0}
