"""Queries that are DataFrame jobs rather than one SQL text: graphs, greedy removal, sources, sinks, streams."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.functions import models
from clauseworks.functions import python as p
from clauseworks.functions import text as r
from clauseworks.functions.dialect import DUCK, SPARK, run
from clauseworks.operators import coredelta, extraction, nearness, ordering, segments
from clauseworks.operators import similarity as s
from clauseworks.plans import fixtures
from clauseworks.plans import queries as q
from clauseworks.runtime import materialize, shared_dir, small_batches
from clauseworks.sources import files, sinks, snapshots, tables
from clauseworks.streaming import feedback, keyed

LINES, CLAUSES = q.INPUTS["lines"][1], q.INPUTS["clauses"][1]
QUERIES: dict[str, q.Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: q.Query) -> q.Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fx_clauses(spark, sf_dir)


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_COSINE = "list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v))"
_DENSE = f"with v as (select vec_id as id, cast(embedding as double[]) as v from embeddings), e as (select x.id as a, y.id as b, round({_COSINE}, 9) as sim from v x join v y on x.id < y.id where round({_COSINE}, 9) >= 0.40)"


@query("T05_dense_edges", f"{_DENSE} select a, b, round(sim, 6) as sim from e")
def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = s.dense_edges(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 0.40)
    return edges.select("a", "b", F.round("sim", 6).alias("sim"))


_REACH = "reach(n, c) as (select a, a from both_ways union select both_ways.b, reach.c from reach join both_ways on both_ways.a = reach.n)"


@query("T06_components", _DENSE.replace("with ", "with recursive ") + f", both_ways as (select a, b from e union select b, a from e), {_REACH} select n as node, min(c) as component from reach group by n")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.components(s.dense_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 0.40))


def _buckets(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """The clauses of buckets of `least` or more. The rules that place them are dear, so what they say is written once."""
    placed = materialize(run(s.categories_sql("<clauses>"), clauses=clauses(spark, sf_dir)), "categories")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("bucket_size")).where(f"bucket_size >= {least}")
    return placed.join(sizes, "bucket").select("bucket", F.col("clause_idx").alias("idx"), "text")


#: Least labels spread along the edges until none changes.
_LABELS = "labels(n, c) using key (n) as (select distinct a, a from both_ways union select b.b, min(l.c) from labels l join both_ways b on b.a = l.n join recurring.labels r on r.n = b.b where l.c < r.c group by b.b)"
_BUCKETED = f"(select bucket, clause_idx as idx, text, bucket_size from ({s.buckets_sql(DUCK, CLAUSES)}) z where bucket_size > 2)"


@query("J07_similarity_edges", f"with w as ({s.tfidf_sql(DUCK, _BUCKETED)}), e as ({s.edges_sql('w', 0.45)}) select bucket, a, b, round(sim + 1e-10, 6) as sim from e")
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _buckets(spark, sf_dir, 3)
    return s.similarity_edges(materialize(s.tfidf(given), "tfidf"), 0.45).select("bucket", "a", "b", F.round(F.col("sim") + 1e-10, 6).alias("sim"))


_GROUPED = f"""
with recursive w as ({s.tfidf_sql(DUCK, _BUCKETED)}), sizes as (select distinct bucket, bucket_size from {_BUCKETED} z1),
e as (select e.a, e.b from ({s.edges_sql('w', 0.35)}) e join sizes on sizes.bucket = e.bucket where sim >= case when bucket_size > {s.LARGE_BUCKET} then {s.LARGE} else 0.35 end),
both_ways as (select a, b from e union select b, a from e), {_LABELS},
found as (select n as node, c as component from labels), b as ({s.buckets_sql(DUCK, CLAUSES)}),
members as (select component, b.* from (select node, component from found union all select clause_idx, bucket_first from b where bucket_size = 2) f join b on b.clause_idx = f.node),
kept as (select component from members group by component having count(*) >= 2 and count(distinct standard_name) >= 2)
select dense_rank() over (order by bucket_first, m.component) - 1 as group_id, clause_idx, category, requirement_type from members m join kept on kept.component = m.component
"""
_EVERY = f"""
with c as (select bucket, clause_idx as idx, text from ({s.buckets_sql(DUCK, CLAUSES)}) z where bucket_size >= 2), w as materialized ({s.tfidf_sql(DUCK, 'c')}),
e as (select bucket, round(sim + 1e-10, 6) as sim, count(*) as n from ({s.edges_sql('w', 0.0)}) group by all having round(sim + 1e-10, 6) > 0),
every as (select bucket, sim, n from e union all select z.bucket, 0.0, z.n - coalesce(e.n, 0) from (select bucket, count(*) * (count(*) - 1) // 2 as n from c group by bucket) z left join (select bucket, sum(n) as n from e group by bucket) e on e.bucket = z.bucket),
ranked as (select *, sum(n) over (partition by bucket order by sim) as upto, sum(n) over (partition by bucket) as total from every where n > 0)
"""


_WEIGHTS = s.tfidf_sql(DUCK, f"(select bucket, clause_idx as idx, text from ({s.buckets_sql(DUCK, CLAUSES)}) z where bucket_size >= 2)")


@query("T03_tfidf", f"select bucket, idx, term, round(weight, 6) as weight from ({_WEIGHTS}) x")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.tfidf(_buckets(spark, sf_dir)).select("bucket", "idx", "term", F.round("weight", 6).alias("weight"))


@query("L07_vocabulary", f"select bucket, count(distinct term) as terms from ({_WEIGHTS}) x group by bucket")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term of a vocabulary is some clause's, so the clauses needn't be weighed."""
    return s.vocabulary(_buckets(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("terms"))


def _similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of each bucket's clauses have each similarity."""
    given = _buckets(spark, sf_dir)
    return s.similarity_counts(given.select("bucket", "idx"), materialize(s.tfidf(given), "tfidf"))


_SHARES = (0.5, 0.75, 0.9, 0.95, 0.99)
_AT = lambda k: f"min(case when upto > {k} then sim end)"
_PERCENTILES = ", ".join(f"round({_AT(f'floor({x} * (total - 1))')} + ({x} * (total - 1) - floor({x} * (total - 1))) * ({_AT(f'ceil({x} * (total - 1))')} - {_AT(f'floor({x} * (total - 1))')}) + 1e-9, 5) as p{round(100 * x)}" for x in _SHARES)


@query("A08_percentiles", f"{_EVERY} select bucket, {_PERCENTILES} from (select bucket, sim, upto, max(total) over (partition by bucket) as total from ranked) group by bucket, total")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similarities(spark, sf_dir).groupBy("bucket").agg(*(F.round(F.percentile("sim", F.lit(x), F.col("n")) + 1e-9, 5).alias(f"p{round(100 * x)}") for x in _SHARES))


@query("A09_threshold_counts", f"{_EVERY} select bucket, {', '.join(f'cast(sum(case when sim >= {x} then n else 0 end) as bigint) as n{round(100 * x)}' for x in (0.3, 0.35, 0.4, 0.45, 0.5))} from ranked group by bucket")
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similarities(spark, sf_dir).groupBy("bucket").agg(*(F.sum(F.when(F.col("sim") >= x, F.col("n")).otherwise(0)).alias(f"n{round(100 * x)}") for x in (0.3, 0.35, 0.4, 0.45, 0.5)))


@query("A10_histogram", f"{_EVERY} select bucket, cast(least(floor(sim * 20), 19) as int) as bin, cast(sum(n) as bigint) as n from ranked group by all")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similarities(spark, sf_dir).groupBy("bucket", F.least(F.floor(F.col("sim") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


@query("A16_group_similarity", f"{_EVERY} select bucket, round(sum(sim * n) / sum(n) + 1e-9, 5) as mean, min(sim) as least, max(sim) as most from ranked group by bucket")
def group_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similarities(spark, sf_dir).groupBy("bucket").agg(F.round(F.sum(F.col("sim") * F.col("n")) / F.sum("n") + 1e-9, 5).alias("mean"), F.min("sim").alias("least"), F.max("sim").alias("most"))


@query("T08_grouped_clauses", _GROUPED)
def grouped_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.grouped_clauses(clauses(spark, sf_dir), staged=False)
    return out.withColumn("group_id", F.col("group_id").cast("long"))


@query("T07_staged_groups")
def staged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.grouped_clauses(clauses(spark, sf_dir))


@query("T01_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.near_duplicates(clauses(spark, sf_dir).select(F.col("clause_idx").alias("id"), "doc_id", "text"), scope="doc_id")


@query("T02_clause_duplicates")
def clause_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.clause_duplicates(clauses(spark, sf_dir).select(F.col("clause_idx").alias("id"), F.concat_ws("/", "doc_id", "clause_number").alias("clause"), "text"))


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with their topic and properties; all documents are consolidated together."""
    topic = F.lit("general")
    for name, words in reversed(coredelta.TOPICS.items()):
        topic = F.when(F.expr(q.any_of("lower(text)", words)), name).otherwise(topic)
    rows = clauses(spark, sf_dir).select(F.col("clause_idx").alias("id"), F.lit(0).cast("long").alias("scope"), "text", F.col("standard_name").alias("standard"), F.col("clause_number").alias("clause"))
    return coredelta.with_properties(rows).withColumn("topic", topic)


@query("T15_topic_splits")
def topic_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coredelta.split_topics(_topics(spark, sf_dir).drop("clause"))


@query("T18_enriched_groups", f"select group_id, substring(split_part(string_agg(standard_name || ' ' || clause_number || ': ' || text, chr(10) order by clause_idx), chr(10), 1), 1, 40) as title, count(*) as clauses from {q.groups_sql(DUCK, CLAUSES)} x group by group_id having count(*) between 2 and 100")
def enriched_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = q.QUERIES["T18_prompts"](spark, sf_dir)
    replies = p.call_model(prompts, "prompt", "reply", p.stub_model)
    body = F.from_json(F.regexp_extract("reply", r"(?s)```(?:json)?\s*(.*?)\s*```", 1), "group_title string, clauses long")
    return replies.select("group_id", body.alias("b")).select("group_id", F.col("b.group_title").alias("title"), "b.clauses")


@query("G13_smart_chunks")
def smart_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixtures.fx_lines(spark, sf_dir)
    texts = lines.groupBy("doc_id").agg(F.expr("listagg(t, '\\n') within group (order by lineno)").alias("text"))
    return p.smart_chunks(texts, tokens=300, overlap=40)


_REPAIRED = "text || ' 25 Â°C'"
for _a, _b in p.GARBLED:
    _REPAIRED = f"replace({_REPAIRED}, {DUCK.lit(_a)}, {DUCK.lit(_b)})"


@query("P01_fixed_encoding", f"select clause_idx, {_REPAIRED} as text from {CLAUSES} as x")
def fixed_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degree sign that is put right makes none of these texts UTF-8 read as Latin-1, so no second reading follows."""
    return clauses(spark, sf_dir).select("clause_idx", p.fix_encoding(F.concat("text", F.lit(" 25 Â°C"))).alias("text"))


@query("P34_repaired_json", f"select clause_idx, clause_number as clause from {CLAUSES} as x")
def repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.lit('```json\n[{"clause": "'), F.col("clause_number"), F.lit('", "text": "two\nlines",},]\n```'))
    body = F.from_json(p.repair_json(broken), "array<struct<clause: string, text: string>>")
    return clauses(spark, sf_dir).select("clause_idx", body[0]["clause"].alias("clause"))


@query("P41_language_filter", "select doc_id from documents where contains(text, ' the ') or length(trim(text)) < 20")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The injected detector is a stand-in that looks for the commonest English word."""
    english = p.language_filter(lambda t: 1.0 if " the " in t else 0.0)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").isNotNull() & english("text")).select("doc_id")


_TAGGED = f"select clause_number, standard_name, text, {r.mandate_level('text')} as mandate_level, {r.category('text', DUCK)} as category from {CLAUSES} as x"


@query("S08_tagged_csv", _TAGGED)
def tagged_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the export as CSV, read it back as tagged clauses."""
    path = folder(spark, "tagged")
    sinks.write_csv(sinks.export_columns(sinks.tagged_rows(clauses(spark, sf_dir))), path)
    return tables.tagged_clauses(tables.read_csv(spark, path)).select("clause_number", "standard_name", "text", "mandate_level", "category")


@query("S12_feedback_lines", f"select event_id % 1000 as id, type, page, rating from {q.feedback_sql(DUCK, 'events')} as x where event_id % 1000 <> 13")
def feedback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with a malformed line for each thousand rows."""
    path = folder(spark, "log")
    rows = run(f"select * from {q.feedback_sql(SPARK, '<events>')} as x", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    line = F.when(F.col("event_id") % 1000 == 13, F.lit('{"type": "cut')).otherwise(F.to_json(F.struct(F.col("type"), F.col("page"), F.col("rating"), (F.col("event_id") % 1000).cast("string").alias("session_id"))))
    rows.select(line.alias("value")).write.text(path)
    return tables.read_feedback(spark, path).select(F.col("session_id").cast("long").alias("id"), "type", "page", "rating")


@query("K03_valid_removed", f"select case when removal_reason is null then 'valid' else 'removed' end as part, clause_idx, text, removal_reason from {q.requirements_sql(DUCK, CLAUSES)} as x")
def valid_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "validated")
    rows = run(f"select clause_idx, text, removal_reason from {q.requirements_sql(SPARK, '<clauses>')} as x", clauses=clauses(spark, sf_dir))
    sinks.write_validated(rows, path)
    read = lambda part: tables.read_csv(spark, f"{path}/{part}").withColumn("part", F.lit(part)).withColumn("clause_idx", F.col("clause_idx").cast("long"))
    return read("valid").unionByName(read("removed"), allowMissingColumns=True).select("part", "clause_idx", "text", "removal_reason")


@query("K04_group_report", f"select group_id, clause_number, standard_name, text from {q.groups_sql(DUCK, CLAUSES)} as x")
def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write groups as JSON, read their clauses back."""
    path = folder(spark, "groups")
    members = run(f"select * from {q.groups_sql(SPARK, '<clauses>')} as x", clauses=clauses(spark, sf_dir))
    sinks.write_json(sinks.nested_groups(members), path)
    return spark.read.schema("group_id long, clauses array<struct<clause_number: string, standard_name: string, text: string>>").json(path).select("group_id", F.inline("clauses"))


def _document(blocks: str, title: str, totals: str, summary: list[tuple[str, str]]) -> str:
    shown = " || ".join(f"'<div class=\"stat\">{name}: ' || cast({c} as varchar) || '</div>'" for c, name in summary)
    head = f"'<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"UTF-8\"><title>{title}</title></head><body><h1>{title}</h1><div class=\"summary\">' || {shown} || '</div>'"
    return f"with blocks as ({blocks}), totals as ({totals}) select cast(0 as bigint) as place, {head} as html from totals union all select row_number() over (order by group_id), html from blocks union all select n_groups + 1, '</body></html>' from totals"


_HTML = f"""
select group_id, '<section><h2>' || {r.escaped_html('min_by(text, clause_idx)')} || '</h2><p>' || case when count(distinct standard_name) >= 3 then 'High Coverage' when count(distinct standard_name) = 2 then 'Medium Coverage' else 'Low Coverage' end || '</p><ul>'
 || string_agg('<li><b>' || standard_name || ' ' || clause_number || '</b> ' || {r.escaped_html('text')} || '</li>', '' order by clause_idx) || '</ul></section>' as html from {q.groups_sql(DUCK, CLAUSES)} as x group by group_id"""
_TOTALS = "count(distinct group_id) as n_groups, count(*) as n_clauses, count(distinct standard_name) as n_standards"
_SUMMARY = [("n_groups", "Requirement Groups"), ("n_clauses", "Total Clauses"), ("n_standards", "Standards Covered")]


@query("K05_group_html", _document(_HTML, "Harmonization Report", f"select {_TOTALS} from {q.groups_sql(DUCK, CLAUSES)} as x", _SUMMARY))
def group_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report: head with totals, a block for each group, foot."""
    members = materialize(run(f"select * from {q.groups_sql(SPARK, '<clauses>')} as x", clauses=clauses(spark, sf_dir)), "members")
    return sinks.html_document(sinks.group_html(sinks.nested_groups(members)), ["group_id"], "Harmonization Report", run(f"select {_TOTALS} from <m>", m=members), _SUMMARY)


def _review_blocks(d, members: str, review: str) -> str:
    """K7: (group_id, html) of groups with their review: status, share, active members cut at 500, standards."""
    shown = "'<div class=\"requirement\"><strong>' || standard_name || '</strong> (Clause ' || clause_number || ')<br>' || substring(text, 1, 500) || case when length(text) > 500 then '...' else '' end || '</div>'"
    return f"""
select m.group_id, '<div class="group ' || lower(status) || '"><h2>Group ' || cast(m.group_id + 1 as string) || '</h2><p>Status: ' || status || ' | Similarity: ' || cast(least(95, 70 + 5 * n) as string) || '% | Requirements: ' || cast(active as string)
  || '</p><div class="core-req">' || replace(core, chr(10), '<br>') || '</div><p>' || standards || '</p>' || coalesce(shown, '') || '</div>' as html
from (select group_id, count(*) as n, count(case when clause_idx % 7 <> 0 then 1 end) as active, {d.distinct_list('standard_name', ', ')} as standards, min_by(text, clause_idx) as first_text,
        {d.listagg(f"case when clause_idx % 7 <> 0 then {shown} end", '', 'clause_idx')} as shown from {members} as x group by group_id) m
join (select group_id, upper(coalesce(status, 'pending')) as status, edited from {review} as y) v on v.group_id = m.group_id, lateral (select coalesce(edited, first_text) as core) c"""


@query("K07_review_report", _document(_review_blocks(DUCK, q.groups_sql(DUCK, CLAUSES), q.review_sql(DUCK, CLAUSES)), "Consolidation Report", f"select {_TOTALS} from {q.groups_sql(DUCK, CLAUSES)} as x", _SUMMARY))
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of a review; members that the reviewer removed aren't shown."""
    given = clauses(spark, sf_dir)
    members = materialize(run(f"select * from {q.groups_sql(SPARK, '<clauses>')} as x", clauses=given), "members")
    blocks = run(_review_blocks(SPARK, "<m>", "<v>"), m=members, v=materialize(run(f"select * from {q.review_sql(SPARK, '<clauses>')} as x", clauses=given), "review"))
    return sinks.html_document(blocks, ["group_id"], "Consolidation Report", run(f"select {_TOTALS} from <m>", m=members), _SUMMARY)


_SORTS = {"Group Number": "group_id", "High to Low": "-potential", "Low to High": "potential", "Topic": "lower(topic)"}
_SORTED = f"(select group_id, least(95, 70 + 5 * count(*)) as potential, min(category) as topic from {{}} as x group by group_id)"


@query("L01_sorted_groups", " union all ".join(f"select '{name}' as sort_by, group_id, row_number() over (order by {by}, group_id) - 1 as place from {_SORTED.format(q.groups_sql(DUCK, CLAUSES))} as y" for name, by in _SORTS.items()))
def sorted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four orders of a list of groups; ties go by number. Places come from a sort of ranges."""
    groups = materialize(run(f"select * from {_SORTED.format(q.groups_sql(SPARK, '<clauses>'))} as y", clauses=clauses(spark, sf_dir)), "groups")
    out = None
    for name, by in _SORTS.items():
        placed = ordering.numbered(groups.select("group_id", F.expr(by).alias("by")), ["by", "group_id"], "place").select(F.lit(name).alias("sort_by"), "group_id", "place")
        out = placed if out is None else out.unionByName(placed)
    return out


def words_or_error(text: str) -> int:
    """A stand-in for an injected tokenizer, which fails on texts with a degree sign."""
    if "°" in text:
        raise ValueError("no such character")
    return len(text.split(" "))


@query("P42_token_count", f"select clause_idx, cast(case when contains(text, '°') then floor(length(text) / 4) else len(string_split(text, ' ')) end as bigint) as tokens from {CLAUSES} as x")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("clause_idx", p.token_count(F.col("text"), words_or_error).alias("tokens"))


@query("P54_usage_cost", f"""with p as (select group_id, 'Consolidate:' || chr(10) || string_agg(standard_name || ' ' || clause_number || ': ' || text, chr(10) order by clause_idx) as prompt from {q.groups_sql(DUCK, CLAUSES)} as x group by group_id having count(*) between 2 and 100)
select group_id, length(prompt) // 4 as prompt_tokens, least(200, length(prompt)) // 4 as reply_tokens, round((length(prompt) // 4) / 1e6 * 3.0 + (least(200, length(prompt)) // 4) / 1e6 * 15.0, 9) as cost from p""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that calls used, and what they cost."""
    asked = models.ask(q.QUERIES["T18_prompts"](spark, sf_dir), "prompt", lambda prompt: prompt[:200])
    return models.cost(asked).select("group_id", "prompt_tokens", "reply_tokens", F.round("cost", 9).alias("cost"))


@query("P55_review_label", f"{_DENSE} select a, b, case when sim >= 0.85 then 'high' when sim >= 0.7 then 'medium' else 'low' end as label from e")
def review_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each pair's similarity."""
    edges = s.dense_edges(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 0.40)
    return edges.select("a", "b", F.when(F.col("sim") >= 0.85, "high").when(F.col("sim") >= 0.7, "medium").otherwise("low").alias("label"))


@query("X04_streamed_feedback", q.ORACLE["A17_feedback_metrics"])
def streamed_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(f"select * from {q.feedback_sql(SPARK, '<events>')} as x", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return feedback.streamed_feedback(spark, rows)


@query("X05_cache_misses", f"select md5(text) as key, count(*) as n, 1 as worked from {CLAUSES} as x group by md5(text)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is started again when more has come, with keys of before: each is worked on once."""
    path = folder(spark, "keyed")
    rows = clauses(spark, sf_dir).withColumn("key", F.md5("text"))
    for part in (rows.where("clause_idx % 2 = 0"), rows):
        part.select("key", "clause_idx").write.mode("append").json(f"{path}/in")
        keyed.work_once(spark, f"{path}/in", "key string, clause_idx long", "key", ["clause_idx"], lambda x: x.select("key"), f"{path}/out", f"{path}/checkpoint", files_at_once=1000)
    done = spark.read.parquet(f"{path}/out").groupBy("key").agg(F.count("*").cast("int").alias("worked"))
    return rows.groupBy("key").agg(F.count("*").alias("n")).join(done, "key")


@query("X02_progress", "with c as (select event_id % 4 as batch, count(*) as rows from events group by all), d as (select batch, rows, cast(sum(rows) over (order by batch) as bigint) as done, cast(sum(rows) over () as bigint) as total from c) select batch, rows, done, cast(30 + 50 * done // total as int) as percent from d")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream that is fed in four parts reports of its batches."""
    path, events = folder(spark, "progress"), spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    seen, out = keyed.Progress(events.count()), None
    for i in range(4):
        events.where(F.col("event_id") % 4 == i).write.mode("append").parquet(f"{path}/in")
        out = keyed.watched(spark.readStream.schema("event_id long").parquet(f"{path}/in"), seen, lambda batch, number: batch.write.format("noop").mode("append").save(), f"{path}/checkpoint")
    return out


@query("X06_completion_order", f"select clause_idx, row_number() over (order by clause_idx) - 1 as place from {CLAUSES} as x")
def completion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that come in an order of their own get the places of their source."""
    came = clauses(spark, sf_dir).select("clause_idx", "doc_id").repartition(7, F.md5(F.col("clause_idx").cast("string")))
    return keyed.in_source_order(came, ["doc_id", "clause_idx"], "place").select("clause_idx", "place")


@query("X06_event_windows", "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.events_by_window(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("P49_normal_columns", f"select clause_idx, text as requirement, standard_name as standard, clause_number as clause, 'N' as image from {CLAUSES} as x")
def normal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = clauses(spark, sf_dir).withColumnsRenamed({"text": "Text", "standard_name": "Standard", "clause_number": "Section"})
    out = tables.normalize_columns(given)
    return out.select("clause_idx", F.col("Requirement (Clause)").alias("requirement"), F.col("`Standard/ Regulation`").alias("standard"), F.col("Clause ID").alias("clause"), F.col("`Contains Image?`").alias("image"))


@query("P53_deltas", f"""select clause_idx, array_to_string(list_filter([case when contains(text, '°C') then 'Temperature: ' || array_to_string(regexp_extract_all(text, '[-0-9]+\\s*°[CF]'), ', ') end,
 case when regexp_matches(text, '[0-9]+\\.?[0-9]*\\s*(mm|cm|m|inch)') then 'Measurements: ' || array_to_string(regexp_extract_all(text, '[0-9]+\\.?[0-9]*\\s*(mm|cm|m|inch)', 1), ', ') end,
 case when contains(lower(text), 'paper') then 'Paper format required' end], lambda x: x is not null), '; ') as deltas from {CLAUSES} as x""")
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    temperature = F.when(t.contains("°C"), F.concat(F.lit("Temperature: "), F.array_join(F.regexp_extract_all("text", F.lit(r"[-0-9]+\s*°[CF]"), F.lit(0)), ", ")))
    measure = r"[0-9]+\.?[0-9]*\s*(mm|cm|m|inch)"
    measures = F.when(t.rlike(measure), F.concat(F.lit("Measurements: "), F.array_join(F.regexp_extract_all("text", F.lit(measure), F.lit(1)), ", ")))
    paper = F.when(F.lower(t).contains("paper"), F.lit("Paper format required"))
    return clauses(spark, sf_dir).select("clause_idx", F.array_join(F.array_compact(F.array(temperature, measures, paper)), "; ").alias("deltas"))


_DIGEST = sinks.row_digest(["clause_idx", "clause_number", "doc_id", "standard_name", "text"])


@query("P56_fingerprint", f"""
with recursive level as (
  select 0 as depth, row_number() over (order by clause_idx) - 1 as place, {_DIGEST} as h, count(*) over () as n from {CLAUSES} as x
  union all select depth + 1, place // {sinks.FAN}, md5(string_agg(h, '' order by place)), any_value((n + {sinks.FAN} - 1) // {sinks.FAN}) from level where n > 1 group by depth, place // {sinks.FAN}
) select h as fingerprint from level where n = 1""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.fingerprint(clauses(spark, sf_dir), "clause_idx")


@query("G10_combined")
def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.combined(fixtures.fx_lines(spark, sf_dir))


@query("D10_rules_pipeline")
def rules_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule-based path from lines to classified rows: sections and clause hits, items, five rules, scope, print."""
    items = segments.combined(fixtures.fx_lines(spark, sf_dir))
    section = "(source = 'section')"
    must = q.first_rule([("source = 'section'", "'Y'"), (r.hard_requirement(SPARK, "text"), "'Y'"), (r.warning_token(SPARK, "text"), "'Y'"), (r.soft_requirement(SPARK, "text"), "'Ambiguous'")], "'N'")
    return items.select("doc_id", "source", "line_number", F.expr("coalesce(nullif(clause_number, ''), heading)").alias("clause"), F.expr(must).alias("must"), F.expr(r.scope(SPARK, "text")).alias("scope"), F.expr(r.formatting(SPARK, "text")).alias("formatting"), F.expr(r.in_print(SPARK, "text", section)).alias("in_print"), "text")


@query("S09_ordered_files", f"select 0 as file_ord, count(*) as n from {CLAUSES} as x where clause_idx % 2 = 0 union all select 1, count(*) from {CLAUSES} as y where clause_idx % 2 = 1")
def ordered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clauses(spark, sf_dir)
    paths = []
    for part in (0, 1):
        paths.append(folder(spark, f"file{part}"))
        sinks.write_csv(sinks.export_columns(sinks.tagged_rows(rows.where(F.col("clause_idx") % 2 == part))), paths[-1])
    return tables.read_tagged(spark, paths).groupBy("file_ord").agg(F.count("*").alias("n"))


@query("S11_header_row", f"select doc_id, coalesce(min(case when lineno <= 10 and regexp_matches(lower(t), 'requirement|description|standard|clause') then lineno - 1 end), 0) as header from {LINES} as x group by doc_id")
def header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sheet of one column."""
    cells = fixtures.fx_lines(spark, sf_dir).select("doc_id", (F.col("lineno") - 1).alias("row_no"), F.array("t").alias("cells"))
    return tables.header_row(cells, "doc_id")


@query("S13_project_files", f"select doc_id as id, clause_idx, text from {CLAUSES} as x")
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save a project for every document, load them again."""
    path = folder(spark, "project")
    sinks.save_projects(clauses(spark, sf_dir).select(F.col("doc_id").alias("id"), "clause_idx", "text"), "clause_idx", path)
    return tables.read_project(spark, path, "struct<clause_idx: bigint, text: string>", lines=True).select(F.col("id").cast("long").alias("id"), "clause_idx", "text")


@query("K09_project_index", f"select cast(doc_id as varchar) as id, md5(string_agg(md5(cast(clause_idx as varchar) || '|' || text), '' order by clause_idx)) as hash, count(*) as requirements_count from {CLAUSES} as x group by doc_id")
def project_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saving again replaces a project's row in the index."""
    rows = clauses(spark, sf_dir).select(F.col("doc_id").alias("id"), "clause_idx", "text")
    index = sinks.save_projects(rows.withColumn("text", F.lit("old")), "clause_idx", folder(spark, "project"))
    return sinks.upsert(index, sinks.save_projects(rows, "clause_idx", folder(spark, "project"))).select("id", "hash", "requirements_count")


@query("S14_project_index", "select 'p' || cast(doc_id as varchar) as id, strftime(date '2024-01-01' + cast(doc_id % 300 as int), '%Y-%m-%d') as last_modified from documents")
def project_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "index")
    modified = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd")
    item = F.struct(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("id"), modified.alias("last_modified"))
    spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.floor(F.col("doc_id") / 100).alias("file")).agg(F.collect_list(item).alias("projects")).select("projects").write.json(path)
    return tables.read_projects(spark, path, lines=True).select("id", "last_modified")


@query("S17_group_clauses", f"select group_id, clause_number, text from {q.groups_sql(DUCK, CLAUSES)} as x where group_id in (select distinct group_id from {q.groups_sql(DUCK, CLAUSES)} as y order by group_id limit 50)")
def group_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "report")
    members = run(f"select * from {q.groups_sql(SPARK, '<clauses>')} as x", clauses=clauses(spark, sf_dir))
    sinks.write_json(sinks.nested_groups(members), path)
    return tables.read_groups(spark, path).select(F.col("group_id").cast("long").alias("group_id"), "clause_number", "text")


@query("K12_appended_feedback", "select count(*) * 2 as n from events")
def appended_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "appended")
    rows = run(f"select type, page, rating, session_id from {q.feedback_sql(SPARK, '<events>')} as x", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    for _ in range(2):
        sinks.append_feedback(rows, path)
    return tables.read_feedback(spark, path).agg(F.count("*").alias("n"))


@query("K13_saved_cache", f"select md5(text) as key, case when min(clause_idx % 4) = 0 then 'new' else 'old' end as value from {CLAUSES} as x group by md5(text)")
def saved_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save a cache, save entries that replace some of it, read what is there."""
    path = folder(spark, "cache")
    keys = clauses(spark, sf_dir).groupBy(F.md5("text").alias("key")).agg(F.min(F.col("clause_idx") % 4).alias("m"))
    for part in (keys.select("key", F.lit("old").alias("value")), keys.where("m = 0").select("key", F.lit("new").alias("value"))):
        sinks.save_cache(part, path)
    return tables.read_cache(spark, path, "key string, value string")


def letter_shares(texts: pd.Series) -> pd.Series:
    """A stand-in for an injected embedding: how often the first letters of the alphabet occur."""
    return texts.map(lambda t: [float(t.count(c)) for c in "abcdefgh"])


_LETTERS = " || ".join(f"cast(length(text) - length(replace(text, '{c}', '')) as varchar) || ' '" for c in "abcdefgh")


@query("T04_injected_vectors", f"select clause_idx, {_LETTERS} as vector from {CLAUSES} as x")
def injected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding of clauses by an injected function, as dense_edges takes it."""
    vectors = s.embedded(clauses(spark, sf_dir).select("clause_idx", "text"), "text", letter_shares)
    return vectors.select("clause_idx", F.concat(F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), " "), F.lit(" ")).alias("vector"))


@query("T09_greedy_resolution")
def greedy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and dropped clauses of a document by pairs that T02's ratio finds near."""
    given = clauses(spark, sf_dir).select("doc_id", F.col("clause_idx").alias("id"), F.col("text").alias("s"))
    return nearness.greedy_keep(given, nearness.near_by_ratio(given.select(F.col("doc_id").alias("scope"), "id", "s"), 0.90))


@query("T14_hybrid_similarity")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid similarity of each member of a split with the split's seed, of whole topics."""
    rows = materialize(_topics(spark, sf_dir), "topics")
    return coredelta.seed_similarities(coredelta.split_topics(rows.drop("clause")), rows).withColumn("similarity", F.round("similarity", 6))


@query("T16_core_groups")
def core_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits of T15 whose common words, statement and similarity pass the three gates."""
    rows = materialize(_topics(spark, sf_dir), "topics")
    split = coredelta.split_topics(rows.drop("clause"))
    return coredelta.core_groups(split.select("id", "seed").join(rows, "id")).withColumns({"least_ratio": F.round("least_ratio", 6), "similarity": F.round("similarity", 6)})


@query("T23_uploads")
def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an upload, with the stand-in for a model that takes each clause as a requirement."""
    standards = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("standard"))
    return extraction.upload(fixtures.fx_lines(spark, sf_dir), standards)[0]


@query("T23_upload_stats")
def upload_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    standards = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("standard"))
    return extraction.upload(fixtures.fx_lines(spark, sf_dir), standards)[1]


_TEXTS = f"select doc_id, {DUCK.listagg('t', chr(10), 'lineno')} as text from {LINES} as x group by doc_id"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(f"select doc_id, {SPARK.listagg('t', chr(10), 'lineno')} as text from <lines> as x group by doc_id", lines=fixtures.fx_lines(spark, sf_dir))


@query("T27_chunked_extraction")
def chunked_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smart chunks of every document, numbered lines as requirements, near-duplicates of a clause removed."""
    return extraction.chunked(_texts(spark, sf_dir))


@query("T12_batched_consolidation", f"""
with placed as (select clause_idx as id, standard_name as standard, text, row_number() over (order by clause_idx) - 1 as place from {CLAUSES} as x),
batched as (select *, floor(place / {extraction.REQUIREMENTS_PER_CALL}) as batch, substring(text, 1, 20) as lead from placed), large as (select batch from batched group by all having count(*) >= {extraction.LEAST_PER_CALL}),
groups as (select batch, lead, min(id) as first from batched join large using (batch) group by all having count(*) >= 3 and count(distinct trim(standard)) >= 2),
numbered as (select *, row_number() over (order by batch, first) - 1 as group_id from groups)
select id, cast(group_id as bigint) as group_id from batched left join numbered using (batch, lead)""")
def batched_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clauses in batches in their order, whatever document they are of."""
    rows = clauses(spark, sf_dir).select(F.lit(0).cast("long").alias("scope"), F.col("clause_idx").alias("id"), F.col("standard_name").alias("standard"), "text")
    return extraction.consolidated(rows).select("id", "group_id")


@query("T25_whole_documents", f"""
with raw as (select doc_id, pos, raw from {DUCK.lines('text', 'doc_id', f'({_TEXTS})')} as s where regexp_matches(raw, '^[ \t]*[0-9]+([.][0-9]+)*[ \t]+[^ \t]'))
select doc_id, regexp_extract(raw, '^[ \t]*([0-9]+([.][0-9]+)*)', 1) as clause, count(*) as n from raw group by all""")
def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.whole_documents(_texts(spark, sf_dir)).groupBy("doc_id", "clause").agg(F.count("*").alias("n"))


@query("G11_bounded_segments")
def bounded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.bounded_segments(fixtures.fx_lines(spark, sf_dir), "all", 40)


# --- files, snapshots, calls -----------------------------------------------------------


def recognised(content: bytes) -> str:
    """A stand-in for text recognition: the image holds the text."""
    return files.image_bytes(content)[3:].decode()


def _made_files(spark: SparkSession, sf_dir: str) -> str:
    """A file for each document: compressed or plain pages, an image, a broken one, or a plain text."""
    path = folder(spark, "files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folders = files.folders_for(docs.count())

    def made(batches):
        for b in batches:
            names, contents = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t, kind = t or "", i % 5
                names.append(f"{i % folders}/{i}" + (".pdf", ".PDF", ".Pdf", ".pdf", ".txt")[kind])
                contents.append((lambda: files.made_document([t, ""], True), lambda: files.made_document([t], False), lambda: files.made_document([""], True, b"IMG" + t.encode()), lambda: b"broken", lambda: t.encode())[kind]())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], names=["name", "content"])

    files.write_named(docs.mapInArrow(made, "name string, content binary"), path)
    return path


_ENOUGH = f"doc_id % 5 <= 2 and length({DUCK.strip('text')}) > 100"


@query("S01_file_router", "select doc_id, case when doc_id % 5 = 4 then 'unsupported' else 'pdf' end as route from documents")
def file_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the query writes, routed by their paths; those that aren't documents aren't read."""
    read = files.by_folder(lambda place: files.read_documents(spark, place, files.READERS, tasks=files.TASKS_AT_ONCE).select("path", "error"), spark, _made_files(spark, sf_dir), "routed")
    return read.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("doc_id"), F.when(F.col("error") == "unsupported", "unsupported").otherwise("pdf").alias("route"))


@query("S02_fallback_chain", f"""select doc_id, case when {_ENOUGH} then case doc_id % 5 when 0 then 'packed pages' when 1 then 'plain pages' else 'recognition' end end as method,
 case when {_ENOUGH} then case doc_id % 5 when 0 then 'high' when 1 then 'medium' else 'low' end end as confidence, {_ENOUGH} as success, case when doc_id % 5 = 4 then 'unsupported' when not ({_ENOUGH}) then 'no text found' end as error,
 case when {_ENOUGH} then md5(trim(text, chr(10))) end as digest from documents""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader of the chain, the limit of 100 characters, and the files that none can read."""
    readers = [*files.READERS, ("recognition", "low", recognised)]
    digest = F.md5(F.regexp_replace("raw_text", r"^\n+|\n+$", ""))
    read = files.by_folder(lambda place: files.read_documents(spark, place, readers, tasks=files.TASKS_AT_ONCE).withColumn("digest", digest).drop("raw_text"), spark, _made_files(spark, sf_dir), "read")
    return read.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("doc_id"), "method", "confidence", "success", "error", "digest")


@query("S11_workbooks", f"select doc_id, clause_number as clause, standard_name as standard, text as requirement from {CLAUSES} as x")
def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each document, with its clauses on the second sheet below a few other rows; read back by sheet and header."""
    path = folder(spark, "books")
    folders = files.folders_for(spark.read.parquet(f"{sf_dir}/documents.parquet").count())

    def books(batches):
        for b in batches:
            names, contents = [], []
            for i, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                above = [["Export"], [], ["of", None, "the day"]][: i % 4]
                table = [["Clause", "", "Requirement", "Standard"], *([x["clause_number"], None, x["text"], x["standard_name"]] for x in rows.as_py())]
                names.append(f"{i % folders}/{i}.xlsx")
                contents.append(files.made_workbook([("Notes", [["Requirement"]]), ("Requirements", [*above, *table])]))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], names=["name", "content"])

    small_batches(spark)
    sheets = clauses(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("clause_idx", "clause_number", "text", "standard_name"))).alias("rows"))
    files.write_named(sheets.mapInArrow(books, "name string, content binary"), path)
    read = files.by_folder(lambda place: files.read_workbooks(spark, place, "Requirements", tasks=files.TASKS_AT_ONCE).select("path", "row_no", "cells"), spark, path, "cells")
    records = files.sheet_records(read, "path")
    column = lambda name, target: files.named_column("values", target).alias(name)
    return records.select(F.regexp_extract("path", r"(\d+)\.xlsx$", 1).cast("long").alias("doc_id"), column("clause", "Clause ID"), column("standard", "Standard/ Regulation"), column("requirement", "Requirement (Clause)"))


@query("K10_index_upsert", f"with old as (select clause_idx as id, text from {CLAUSES} as x where clause_idx % 2 = 0), new as (select clause_idx as id, 'new' as text from {CLAUSES} as y where clause_idx % 3 = 0) select id, text from old where not exists (select 1 from new where new.id = old.id) union all select id, text from new")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two changes of a table of versions; the second replaces keys of the first."""
    rows = clauses(spark, sf_dir).select(F.col("clause_idx").alias("id"), "text")
    table = snapshots.SnapshotTable(spark, folder(spark, "index"), "id long, text string")
    table.replace(rows.where("id % 2 = 0"))
    table.upsert(rows.where("id % 3 = 0").withColumn("text", F.lit("new")))
    return table.read()


@query("W05_undone_changes", f"select clause_idx as id, case when clause_idx % 3 = 0 then 'second' else 'first' end as text from {CLAUSES} as x where clause_idx % 5 <> 0")
def undone_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five changes the newest two are taken back."""
    rows = clauses(spark, sf_dir).select(F.col("clause_idx").alias("id"))
    table = snapshots.SnapshotTable(spark, folder(spark, "undo"), "id long, text string")
    table.replace(rows.withColumn("text", F.lit("first")))
    table.upsert(rows.where("id % 3 = 0").withColumn("text", F.lit("second")))
    table.delete(rows.where("id % 5 = 0"))
    table.upsert(rows.withColumn("text", F.lit("third")))
    table.delete(rows)
    assert table.restore() and table.restore()
    return table.read()


_SECTIONS = f"(select doc_id, start_line as chunk, clause_number, content from ({segments.manual_sections_sql(DUCK, LINES)}) s)"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.manual_sections(fixtures.fx_lines(spark, sf_dir)).select("doc_id", F.col("start_line").alias("chunk"), "clause_number", "content")


@query("T24_sections", f"select doc_id, cast(chunk as bigint) as chunk, clause_number as clause, rtrim(content, chr(10)) as text from {_SECTIONS} as x")
def extracted_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each section, no duplicates removed; the stand-in model fails on its first call in a process and is asked again."""
    calls = []

    def flaky(prompt: str) -> str:
        calls.append(prompt)
        if len(calls) == 1:
            raise models.Overloaded("busy")
        return extraction.echo_clauses(prompt)

    rows, _, _ = extraction.extract_sections(_sections(spark, sf_dir), flaky, policy=models.Policy(delay=0.01))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "clause", "text")


@query("T22_cached_sections", f"with s as (select *, md5('manual:' || content) as key from {_SECTIONS} as x) select doc_id, cast(chunk as bigint) as chunk, key in (select key from s where doc_id % 2 = 0) as cached from s")
def cached_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of half of the documents fill the cache; of all sections only the others are asked for."""
    sections = materialize(_sections(spark, sf_dir), "sections")
    _, cache, _ = extraction.extract_sections(sections.where("doc_id % 2 = 0"))
    rows, _, _ = extraction.extract_sections(sections, cache=materialize(cache, "cache"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "cached").distinct()


def only_larger(prompt: str) -> str:
    """A stand-in for consolidation's model, whose answers to groups of two are no JSON."""
    return "can't say" if prompt.count("\n") == 2 else p.stub_model(prompt)


@query("T28_consolidation", f"with g as (select group_id, 'Consolidate:' || chr(10) || string_agg(standard_name || ' ' || clause_number || ': ' || text, chr(10) order by clause_idx) as prompt from {q.groups_sql(DUCK, CLAUSES, None)} as x group by group_id), c as (select group_id, length(prompt) - length(replace(prompt, chr(10), '')) as lines from g) select group_id, case when lines > 2 then cast(lines as bigint) end as clauses, case when lines = 2 then 'unusable reply' end as failure from c")
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of the whole load, of any size. Their sizes are a row for each bucket, so no window holds a bucket."""
    placed = materialize(run(s.categories_sql("<clauses>"), clauses=clauses(spark, sf_dir)), "categories")
    groups = placed.groupBy("bucket").agg(F.min("clause_idx").alias("group_id"), F.min("standard_name").alias("s1"), F.max("standard_name").alias("s2")).where("s1 <> s2")
    members = placed.join(F.broadcast(groups), "bucket").select("group_id", F.col("clause_idx").alias("id"), F.col("standard_name").alias("standard"), F.col("clause_number").alias("clause"), "text")
    asked = models.consolidation(extraction.group_prompts(members), "prompt", only_larger, "permitted", "permitted")
    return extraction.whole_groups(asked, "clauses long")
