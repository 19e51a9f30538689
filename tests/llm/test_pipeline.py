"""The pipeline: columns, effects of each stage, awkward documents, and rows against a plain recomputation."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from clauseworks.llm import decontaminate, line_templates, quality
from clauseworks.llm.pretoken import ranks
from clauseworks.llm.shingles import shingle_set

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "stage")
        out.append((name, docs))
    return out


def test_stage_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for _, docs in stages[:-1]:
        assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(stages[-1][1].columns)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_stage_keeps_by_score(spark, sf, stages):
    before, after = by_id(stages[0][1]), by_id(stages[1][1])
    model = quality.fit(stages[0][1], spark.read.parquet(f"{sf}/labels.parquet"))
    expected = {r.doc_id for r in quality.score(stages[0][1], model).collect() if r.score >= quality.THRESHOLD}
    assert set(after) == expected
    assert 0 < len(after) < len(before)


def test_line_stage_leaves_each_long_line_in_one_document(stages):
    seen = {}
    for i, r in by_id(stages[2][1]).items():
        for line in set(r.text.split("\n")):
            if len(line.split(" ")) >= line_templates.LEAST_TOKENS and not any(c.isdigit() for c in line):
                assert seen.setdefault(line, i) == i
    before = by_id(stages[1][1])
    for i, r in by_id(stages[2][1]).items():
        assert set(r.text.split("\n")) <= set(before[i].text.split("\n"))
        assert r.n_chars == len(r.text)


def test_jaccard_stage_keeps_one_of_each_group(stages):
    before, after = by_id(stages[2][1]), by_id(stages[3][1])
    sets = {i: set(shingle_set(r.text, 5).tolist()) for i, r in before.items()}
    near = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = sorted(after)
    assert not any(near(a, b) for i, a in enumerate(kept) for b in kept[:i])
    for gone in set(before) - set(after):
        assert any(near(gone, other) for other in before if other != gone)


def test_decontamination_stage_drops_only_leaks(spark, sf, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontaminate.Index(items, decontaminate.RADIUS, decontaminate.THRESHOLD, 5).built
    before, after = by_id(stages[3][1]), by_id(stages[4][1])
    assert set(after) == {i for i, r in before.items() if not index.leaks(r.text)}
    assert not any(t in r.text for r in after.values() for _, t in items)


def test_encoding_stage(stages):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    before, after = by_id(stages[4][1]), by_id(stages[5][1])
    assert set(before) == set(after)
    for i, r in after.items():
        ids = library.encode_ordinary(before[i].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(before[i].text.encode()).hexdigest())


def test_run_equals_the_stages(spark, sf, stages):
    assert sorted(map(repr, corpus_pipeline.run(spark, sf).collect())) == sorted(map(repr, stages[-1][1].collect()))


def test_every_stage_takes_awkward_and_empty_tables(spark, sf):
    rows = [(1, None, None, None, None), (None, "some text without id", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 20_000, "en", "s", 100_000), (4, "plain good line of text here", None, "s", None), (5, "plain good line of text here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.where("false")):
            out = stage(spark, given, sf)
            assert out.count() <= given.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS)
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "stage")
    assert {1, 2, None} <= {r.doc_id for r in docs.collect()}


def test_other_columns_and_repeated_rows(spark, sf):
    """Names that the operators use inside are handed on; of rows with one id and text one is left after the join."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, passage, "en", "s", 5), (1, passage, "en", "s", 5), (1, passage + " more", "en", "s", 5), (2, passage + " end", "en", "s", 5), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (None, passage, "en", "s", 5), (4, None, "en", "s", None)]
    extra = {"quality_score": 7.0, "n_lines": 8, "n_dropped": 9, "content": "c", "kept": True, "row": 3}
    docs = spark.createDataFrame([(*r, *extra.values()) for r in rows], DOCUMENTS + ", quality_score double, n_lines int, n_dropped int, content string, kept boolean, row int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(docs.columns), name
        assert all(r[k] == v for r in out.collect() for k, v in extra.items()), name
    left = corpus_pipeline.ngram_jaccard_join(spark, docs, sf).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left))) == sorted(map(repr, [(1, passage), (3, ""), (3, ""), (None, passage), (4, None)]))
