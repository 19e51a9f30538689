"""Graphs, greedy removal, segmentation invariants, sources and sinks on small inputs."""

import math
import random
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseworks.functions import python as p
from clauseworks.functions.dialect import DUCK, SPARK, run
from clauseworks.operators import coredelta, graph, segments
from clauseworks.operators import similarity as s
from clauseworks.operators.graph import connected_components
from clauseworks.runtime import materialize
from clauseworks.sources import sinks, tables
from clauseworks.streaming import feedback


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (100, 101)] + [(None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def components_by_search(edges):
    near, out = {}, {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for start in sorted(near):
        queue = [] if start in out else [start]
        while queue:
            x = queue.pop()
            if x not in out:
                out[x] = start
                queue += near[x]
    return out


@pytest.mark.parametrize("shape", ["random", "reversed", "zigzag", "least id at the far end"])
def test_components_of_long_chains_settle_in_logarithmic_rounds(spark, monkeypatch, shape):
    n = 5000
    order = list(range(n))
    if shape == "random":
        random.Random(1).shuffle(order)
    elif shape == "reversed":
        order.reverse()
    elif shape == "zigzag":
        order = [x for pair in zip(range(n // 2), range(n - 1, n // 2 - 1, -1), strict=True) for x in pair]
    else:
        order = [*range(1000, 1000 + n - 1), 0]
    rounds = []
    monkeypatch.setattr(graph, "materialize", lambda df, name: rounds.append(name) or materialize(df, name))
    edges = list(zip(order, order[1:], strict=False))
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(order, 0)
    assert rounds.count("moves") <= 2 * math.log2(n)


def test_components_of_a_large_random_graph(spark):
    rng = random.Random(2)
    edges = [(i, rng.randrange(i)) for i in range(1, 100_000)] + [(200_000 + rng.randrange(3000), 200_000 + rng.randrange(3000)) for _ in range(1500)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components_by_search(edges)


def greedy(texts, threshold):
    kept, out = [], {}
    for i, t in enumerate(texts):
        t = t.strip().lower()
        hit = next((j for j, k in kept if k and t and SequenceMatcher(None, t, k).ratio() >= threshold), None)
        out[i] = hit
        if hit is None:
            kept.append((i, t))
    return out


def test_near_duplicates_follow_the_sequential_rule(spark):
    base = "the battery pack shall be marked with rated voltage and a legible label number"
    texts = [base, base.upper(), base + "s", "", " ", base[:-7], "another text entirely about drop tests and vibration", base.replace("rated", "rateD x"), "ab", "ab", base[3:], ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {r.id: r.original for r in s.near_duplicates(rows).collect()} == greedy(texts, 0.95)


def test_clause_duplicates_stay_within_a_clause(spark):
    rows = [(0, "1", "the pack shall be marked"), (1, "1", "the pack shall be marked."), (2, "2", "the pack shall be marked"), (3, "", "x"), (4, "1", "")]
    got = {r.id: r.original for r in s.clause_duplicates(spark.createDataFrame(rows, "id long, clause string, text string")).collect()}
    assert got == {0: None, 1: 0, 2: None}


@settings(max_examples=30, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_letters(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert coredelta.common_letters(a, b) == table[-1][-1]


def test_staged_clusters(spark):
    edges = [(0, 1, 0.6), (1, 2, 0.52), (2, 3, 0.46), (3, 4, 0.40), (5, 6, 0.9), (4, 5, 0.41)]
    e = spark.createDataFrame([(0, *x) for x in edges], "component long, a long, b long, sim double")
    n = spark.createDataFrame([(0, i) for i in range(7)], "component long, node long")
    got = {r.node: r.cluster for r in s.staged_clusters(e, n, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5}


def test_two_clause_bucket_is_a_group_whatever_the_similarity(spark):
    rows = [(0, "a", "9", "disposal one"), (1, "b", "9", "recycle other words"), (2, "a", "9", "packaging"), (3, "a", "9", "shipping")]
    got = s.grouped_clauses(spark.createDataFrame(rows, "clause_idx long, standard_name string, clause_number string, text string")).collect()
    assert sorted((r.group_id, r.clause_idx) for r in got) == [(0, 0), (0, 1)]


def test_sections_cover_the_lines_after_the_first_heading(spark):
    rows = [(1, i + 1, t) for i, t in enumerate(["intro", "1.1 General things", "text 1", "1.2 More Things", "text 2", "1.3 Also This", "x 3", "1.4 And That", "y 4", "1.5 Final Words"])]
    got = sorted((r.start_line, r.end_line, r.clause_number) for r in segments.all_sections(spark.createDataFrame(rows, "doc_id long, lineno int, t string")).collect() if r.end_line)
    assert got == [(2, 3, "1.1"), (4, 5, "1.2"), (6, 7, "1.3"), (8, 9, "1.4")]


def test_few_sections_fall_back_to_pages(spark):
    rows = [(1, i + 1, f"line {i}") for i in range(120)]
    got = segments.all_sections(spark.createDataFrame(rows, "doc_id long, lineno int, t string")).collect()
    assert sorted((r.start_line, r.end_line, r.heading) for r in got) == [(1, 50, "Page 1"), (51, 100, "Page 2"), (101, 120, "Page 3")]


def test_merge_batches(spark):
    sizes = [50, 60, 100, 4990, 30, 4990, 300]
    got = {r.ord: r.batch for r in segments.merge_batches(spark.createDataFrame([(1, i + 1, n) for i, n in enumerate(sizes)], "doc_id long, ord int, n int")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 3, 7: 4}


def test_manual_sections_and_open_lines_of_random_headings(spark):
    """Sections end where a join of each heading with all later lines says, whatever the numbers begin with."""
    rng = random.Random(5)
    heads = ["1 Instructions for use", "1.2 INSTRUCTIONS FOR USE", "12 User information", "A.1 Instructions for use", "10 OTHER", "1.3 OTHER", "2 OTHER", "120 OTHER", "12.4 OTHER", "A.2 OTHER", "INSTRUCTIONS FOR USE", "EN 60335: INSTRUCTIONS FOR USE", "1.2 INSTRUCTIONS FOR USE ..... 4"]
    rows = [(doc, n + 1, rng.choice(heads if doc % 4 == 0 else heads[:10]) if rng.random() < 0.4 else rng.choice(["", "text", "7"])) for doc in range(12) for n in range(rng.choice([30, 700]))]
    lines = spark.createDataFrame(rows, "doc_id long, lineno int, t string")
    held = lines.toPandas()  # noqa: F841
    for sql in (segments.manual_sections_sql, lambda d, t: f"with s as ({segments.manual_sections_sql(d, t)}) select doc_id, lineno from ({segments.open_lines_sql(d, t, 's')}) l"):
        want = duckdb.connect().execute(sql(DUCK, "held")).fetchall()
        assert sorted(map(tuple, run(sql(SPARK, "<lines>"), lines=lines).collect())) == sorted(want)
        assert len(want) > 50


def batches_brute(sizes):
    out, batch, size, started = [], 0, 0, False
    for n in sizes:
        if started and size + n > segments.MOST_CHARS:
            batch, size = batch + 1, 0
        size, started = size + n, True
        out.append(batch)
        if size >= segments.LEAST_CHARS:
            batch, size, started = batch + 1, 0, False
    return out


def test_merge_batches_of_random_and_many_sections(spark):
    rng = random.Random(6)
    sections = {doc: [rng.choice([0, 1, 40, 150, 199, 200, 4900, 5001]) for _ in range(rng.randrange(1, 60))] for doc in range(40)}
    sections[99] = [rng.randrange(0, 200) for _ in range(30_000)]
    rows = [(doc, i + 1, n) for doc, sizes in sections.items() for i, n in enumerate(sizes)]
    got = segments.merge_batches(spark.createDataFrame(rows, "doc_id long, ord int, n int")).collect()
    assert {(r.doc_id, r.ord): r.batch for r in got} == {(doc, i + 1): b for doc, sizes in sections.items() for i, b in enumerate(batches_brute(sizes))}


def test_segments_of_a_long_text_close_above_the_limit(spark):
    rng = random.Random(7)
    texts = ["x" * rng.choice([0, 3, 40, 90]) for _ in range(30_000)]
    got = segments.bounded_segments(spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, lineno int, t string"), "all", 20).collect()
    part, size, want = 0, 0, {}
    for t in texts:
        want.setdefault(part, []).append(t)
        part, size = (part + 1, 0) if size + len(t) // 4 > 20 else (part, size + len(t) // 4)
    assert {r.part: r.content for r in got} == {k: "\n".join(x) for k, x in want.items()}


def test_segments_need_a_remainder(spark):
    rows = [(1, 1, "7.1 First line of text here"), (1, 2, "a) Longer text follows here"), (1, 3, "b) short"), (1, 4, "c) lower case text follows")]
    got = sorted((r.chunk, r.clause_number, r.start_line, r.end_line) for r in segments.segments(spark.createDataFrame(rows, "doc_id long, lineno int, t string"), "manual").collect())
    assert got == [(0, "N/A", 1, 1), (1, "a)", 2, 4)]


def test_segments_close_above_the_limit(spark):
    rows = [(1, 1, "7.1 First line of text here"), (1, 2, "x" * 40), (1, 3, "y" * 40), (1, 4, ""), (1, 5, "z" * 40), (1, 6, "7.2 Next clause of the text"), (1, 7, "w")]
    got = sorted((r.chunk, r.part, r.clause_number, r.start_line, r.end_line) for r in segments.bounded_segments(spark.createDataFrame(rows, "doc_id long, lineno int, t string"), "all", 20).collect())
    assert got == [(0, 0, "N/A", 1, 3), (0, 1, "N/A", 4, 5), (1, 0, "7.2", 6, 7)]


def test_header_row_and_columns(spark):
    cells = spark.createDataFrame([(0, ["", "x"]), (1, ["Clause", "Description"]), (2, ["standard", ""])], "row_no int, cells array<string>")
    assert tables.header_row(cells).first().header == 1
    df = spark.createDataFrame([("a", "b")], "Requirement string, Text string")
    assert tables.normalize_columns(df).columns == ["Requirement (Clause)", "Text", "Contains Image?", "Safety Notice Type"]


def test_extract_files_falls_through_readers(spark):
    files = spark.createDataFrame([("a.pdf", b"x"), ("b.txt", b"y"), ("c.PDF", b"long")], "path string, content binary")

    def broken(raw):
        raise ValueError("no")

    def reader(raw):
        return raw.decode() * 50 if raw == b"long" else "short"

    got = {r.path: (r.method, r.success, r.error) for r in tables.extract_files(files, [("one", "high", broken), ("two", "low", reader)]).collect()}
    assert got == {"a.pdf": (None, False, "no text found"), "b.txt": (None, False, "unsupported"), "c.PDF": ("two", True, None)}


def test_upsert_delete_fingerprint(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, x string")
    new = spark.createDataFrame([(2, "B")], "id long, x string")
    assert sorted(r.x for r in sinks.upsert(old, new).collect()) == ["B", "a", "c"]
    assert sorted(r.x for r in sinks.delete(old, "id", 1).collect()) == ["b", "c"]
    shuffled = new.unionByName(old.where("id = 1"))
    assert sinks.fingerprint(shuffled, "id").first() == sinks.fingerprint(shuffled.orderBy("id"), "id").first()


def test_json_and_encoding_repair(spark):
    df = spark.createDataFrame([('```json\n[{"a": "x\ny",},]\n```',), (None,)], "t string").select(p.repair_json("t"))
    assert [r[0] for r in df.collect()] == ['[{"a": "x\\ny"}]', None]
    df = spark.createDataFrame([("25 Â°C",), ("cafÃ©",), ("",)], "t string").select(p.fix_encoding("t"))
    assert [r[0] for r in df.collect()] == ["25 °C", "café", ""]


def test_smart_chunks(spark):
    sections = "".join(f"\n{i}.1 Heading of a section\nbody {i} " + "w" * 50 for i in range(1, 9))
    df = spark.createDataFrame([(1, "lost" + sections), (2, "x" * 250), (3, None)], "doc_id long, text string")
    got = p.smart_chunks(df, tokens=40, overlap=5).toPandas()
    assert "".join(got[got.doc_id == 1].chunk) == sections
    assert [len(c) for c in got[got.doc_id == 2].chunk] == [160, 110]
    assert isinstance(got, pd.DataFrame)


def test_stream_is_ingested_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, "s1"), ("b", None, "s2")], "type string, rating int, session_id string")
    log, table, mark = (f"file://{tmp_path}/{x}" for x in ("log", "table", "mark"))
    for _ in range(2):
        sinks.append_feedback(rows, log)
        feedback.ingest_feedback(spark, log, table, mark)
    feedback.ingest_feedback(spark, log, table, mark)
    assert feedback.feedback_metrics(spark.read.parquet(table)).first().asDict() == {"total": 4, "rating": 5.0, "sessions": 2}


def test_release_deletes_what_was_written(spark):
    from clauseworks.runtime import release

    kept = materialize(spark.range(3))
    assert kept.count() == 3
    release(spark)
    path = kept.inputFiles()[0].removeprefix("file:").replace("//", "/")
    import os

    assert not os.path.exists(path)
