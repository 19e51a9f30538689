"""Sinks: exports, reports, logs, caches, the project index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.functions import fixed as v
from clauseworks.functions import text as rules
from clauseworks.operators.ordering import numbered
from clauseworks.runtime import materialize


def export_columns(df: DataFrame, with_id: bool = True) -> DataFrame:
    """K1, K2: the export columns in order, with defaults for those that are missing or null."""
    names = [c for c in v.EXPORT_DEFAULTS if with_id or c != "Requirement ID"]
    return df.select(*((F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(v.EXPORT_DEFAULTS[c])) if c in df.columns else F.lit(v.EXPORT_DEFAULTS[c])).alias(c) for c in names))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_validated(df: DataFrame, path: str) -> None:
    """K3: rows with removal_reason null to valid/, the others to removed/."""
    write_csv(df.where("removal_reason is null").drop("removal_reason"), f"{path}/valid")
    write_csv(df.where("removal_reason is not null"), f"{path}/removed")


def nested_groups(members: DataFrame) -> DataFrame:
    """K4: a row for each group with its clauses in order (group_id, core_requirement, clauses, standards, clause_count)."""
    clause = F.struct("clause_idx", "clause_number", "standard_name", "text")
    out = members.groupBy("group_id").agg(F.sort_array(F.collect_list(clause)).alias("clauses"), F.array_sort(F.collect_set("standard_name")).alias("standards"), F.count("*").alias("clause_count"), F.min_by("text", "clause_idx").alias("core_requirement"))
    return out.select("group_id", "core_requirement", "clauses", "standards", "clause_count")


def group_html(groups: DataFrame) -> DataFrame:
    """K5: the HTML block of each group of nested_groups."""
    member = F.transform("clauses", lambda c: F.concat(F.lit("<li><b>"), F.expr("''"), c["standard_name"], F.lit(" "), c["clause_number"], F.lit("</b> "), _escaped(c["text"]), F.lit("</li>")))
    n = F.size("standards")
    status = F.when(n >= 3, "High Coverage").when(n == 2, "Medium Coverage").otherwise("Low Coverage")
    return groups.select("group_id", F.concat(F.lit("<section><h2>"), _escaped(F.col("core_requirement")), F.lit("</h2><p>"), status, F.lit("</p><ul>"), F.array_join(member, ""), F.lit("</ul></section>")).alias("html"))


def _escaped(c: F.Column) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_feedback(df: DataFrame, path: str) -> None:
    """Append JSON lines; a text file of its own for each writing task."""
    df.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows whose key is not among the new ones, then the new ones."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def save_cache(entries: DataFrame, path: str) -> None:
    """Append the entries (key, ...); read_cache takes the newest of a key, so nothing is rewritten."""
    entries.withColumn("saved", F.unix_micros(F.current_timestamp())).write.mode("append").json(path)


def save_projects(rows: DataFrame, order: str, path: str) -> DataFrame:
    """K9: write a project for each id of rows (id, order, text), and return their index rows (id, last_modified, hash, requirements_count).

    A project's records are ordered; its hash is that of its rows' hashes.
    """
    row = F.md5(F.concat_ws("|", F.col(order).cast("string"), "text"))
    kept = F.sort_array(F.collect_list(F.struct(F.col(order), F.col("text"), row.alias("h"))))
    saved = rows.groupBy(F.col("id").cast("string").alias("id")).agg(kept.alias("rows"))
    records = F.to_json(F.transform("rows", lambda x: F.struct(x[order].alias(order), x["text"].alias("text"))))
    digest = F.md5(F.array_join(F.transform("rows", lambda x: x["h"]), ""))
    saved.select(F.struct("id", F.concat(F.lit("project "), "id").alias("name"), digest.alias("hash")).alias("metadata"), F.struct(records.alias("dataframe_json")).alias("source_data")).write.mode("append").json(path)
    return saved.select("id", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"), digest.alias("hash"), F.size("rows").cast("long").alias("requirements_count"))


def delete(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Rows whose key is none of the values; null keys stay."""
    return df.where(~F.coalesce(F.col(key).isin(*values), F.lit(False)))


#: Digests of a level of fingerprint() that make one of the next.
FAN = 1000


def row_digest(columns: list[str]) -> str:
    """SQL for the md5 of columns: `-` for null, else length, colon and value."""
    one = lambda c: f"coalesce(cast(length(cast({c} as string)) as string) || ':' || cast({c} as string), '-')"
    return f"md5({' || '.join(map(one, columns))})"


def fingerprint(df: DataFrame, order: str) -> DataFrame:
    """One digest of all rows in order, by a tree: FAN digests make one of the next level, so no task holds the frame.

    It changes with any value, with a row more or less and with the order of the column, not with
    how the rows lie. Columns are taken in the order of their names. A table of one row has that row's
    digest, an empty one gives no row.
    """
    level = numbered(df.select(F.col(order).alias("o"), F.expr(row_digest(sorted(df.columns))).alias("h")), ["o", "h"], "place").select("place", "h")
    while level.limit(2).count() > 1:
        groups = level.groupBy(F.floor(F.col("place") / FAN).alias("at")).agg(F.md5(F.expr("listagg(h, '') within group (order by place)")).alias("h"))
        level = materialize(groups.select(F.col("at").alias("place"), "h"), "digests")
    return level.select(F.col("h").alias("fingerprint"))


def html_document(blocks: DataFrame, order: list[str], title: str, totals: DataFrame, summary: list[tuple[str, str]]) -> DataFrame:
    """K5, K7: (place, html): the lines of a whole report: its head with the totals, a block for each row (order, html), its foot.

    totals is one row; summary names its columns and what they are called. Blocks are numbered from 1 by a
    sort of ranges, so a report of any length is written in parts whose names sort.
    """
    shown = F.concat(*(F.concat(F.lit(f"<div class=\"stat\">{name}: "), F.col(c).cast("string"), F.lit("</div>")) for c, name in summary))
    head = F.concat(F.lit(f"<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"UTF-8\"><title>{title}</title></head><body><h1>{title}</h1><div class=\"summary\">"), shown, F.lit("</div>"))
    body = numbered(blocks, order, "n").select((F.col("n") + 1).alias("place"), "html")
    foot = totals.select((F.col("n_groups") + 1).cast("long").alias("place"), F.lit("</body></html>").alias("html"))
    return totals.select(F.lit(0).cast("long").alias("place"), head.alias("html")).unionByName(body).unionByName(foot)


def write_document(report: DataFrame, path: str) -> None:
    """Write html_document() as text files that make the report one after the other."""
    report.orderBy("place").select("html").write.mode("overwrite").text(path)


def tagged_rows(clauses: DataFrame) -> DataFrame:
    """The tagged export of a clause table (clause_number, standard_name, text)."""
    from clauseworks.functions.dialect import SPARK

    e = lambda sql, name: F.expr(sql).alias(name)
    return clauses.select(
        e(rules.requirement_id(SPARK, "standard_name", "clause_number", "text"), "Requirement ID"),
        F.col("text").alias("Description"),
        F.col("standard_name").alias("Standard/Reg"),
        F.col("clause_number").alias("Clause/Requirement"),
        e(rules.mandate_level("text"), "Mandate_Level"),
        e(rules.safety_flag("text"), "Safety_Flag"),
        e(rules.manual_flag("text"), "Manual_Flag"),
    )
