"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry_point
from clauseworks.plans import jobs, queries

QUERIES = queries.QUERIES | jobs.QUERIES
ORACLE = queries.ORACLE | jobs.ORACLE
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    db.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return db


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    found = duck.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", ["G08_lettered_items", "G09_numbered_items"])
def test_lines_of_sections_are_dealt_once(spark, sf, name):
    """Sections are made of lines written once, and their items are read once: what is dealt out are blocks of sections and lines of contents."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 2


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(5).collect()


def test_entry(spark):
    out = entry_point.entry(spark)
    assert out.count() > 0
    assert {f.dataType for f in out.schema} <= {T.StringType(), T.LongType()}


def test_every_check_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", ["A20_common_words", "A21_core_ratio", "U05_shared_words"])
def test_words_of_clauses_are_not_dealt_out(spark, sf, name):
    """Words are counted for a group before they are dealt, so no exchange goes by clause and no text is sent to a window."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Window" in x or ("hashpartitioning" in x and "clause_idx" in x)]


def test_a_statement_is_made_of_the_known_words():
    from clauseworks.operators import coredelta

    texts = [" ".join([*coredelta.CONCEPTS, "shall include"])] * 2, ["battery one"] * 2, ["one two"] * 2, ["one shall"] * 2
    assert set(" ".join(coredelta.core_statement(t)[0] for t in texts).lower().split()) <= set(queries.CORE_WORDS)
