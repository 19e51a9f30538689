"""Sources: tagged CSV, uploads, JSON lines, project files, caches, and files of any kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that an upload's columns may have
SYNONYMS = {
    "Requirement (Clause)": ["Description", "Requirement", "Requirement Text", "Text"],
    "Standard/ Regulation": ["Standard/Reg", "Standard", "Regulation", "Standard Name"],
    "Clause ID": ["Clause/Requirement", "Clause", "Clause Number", "Section"],
}
COLUMN_DEFAULTS = {"Contains Image?": "N", "Safety Notice Type": "None"}
FEEDBACK = "timestamp string, type string, page string, text string, email string, rating int, session_id string"
GROUPS = "group_id long, core_requirement string, clauses array<struct<clause_number: string, standard_name: string, text: string>>, category string"

# Column of the tagged CSV -> column of the clause table
TAGGED = {
    "Requirement scope": "requirement_scope",
    "Formatting required?": "formatting_required",
    "Required in Print?": "required_in_print",
    "Parent Section": "parent_section",
    "Comments": "comments",
    "Contains Image?": "contains_image",
    "Safety Notice Type": "safety_notice_type",
    "Clause_Type": "clause_type",
    "Mandate_Level": "mandate_level",
    "Safety_Flag": "safety_flag",
    "Manual_Flag": "manual_flag",
}


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV with a header; quoted fields may hold quotes and line breaks; all columns are strings."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def _either(df: DataFrame, *names: str) -> F.Column:
    """The first of the columns that is there and not empty."""
    found = [F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def tagged_clauses(df: DataFrame) -> DataFrame:
    """The clause table of a tagged CSV; rows without clause or text are left out.

    The standard is that of the row, else the file name's letters and digits, else Unknown.
    """
    from clauseworks.functions import text as rules

    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    prefix = F.regexp_replace(F.regexp_extract(file, r"([A-Z_]+)_(\d+)", 1), "_", " ")
    number = F.regexp_extract(file, r"([A-Z_]+)_(\d+)", 2)
    named = F.when(number != "", F.concat_ws(" ", prefix, number))
    out = df.select(
        _either(df, "Clause/Requirement", "clause").alias("clause_number"),
        F.coalesce(_either(df, "Standard/Reg"), named, F.lit("Unknown")).alias("standard_name"),
        _either(df, "Description", "text").alias("text"),
        *(_either(df, a).alias(b) for a, b in TAGGED.items()),
    ).where("clause_number is not null and text is not null")
    return out.withColumn("category", F.expr(rules.category("text")))


def read_tagged(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several tagged files one after the other, with file_ord."""
    out = None
    for i, p in enumerate(paths):
        part = tagged_clauses(read_csv(spark, p)).withColumn("file_ord", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename the first synonym that is there, unless the name is taken; add two columns with defaults."""
    names = {}
    for target, given in SYNONYMS.items():
        found = [n for n in given if n in df.columns]
        if found and target not in df.columns:
            names[found[0]] = target
    out = df.withColumnsRenamed(names)
    return out.withColumns({c: F.lit(x) for c, x in COLUMN_DEFAULTS.items() if c not in out.columns})


def header_row(cells: DataFrame, *by: str) -> DataFrame:
    """(by, header) the first of the first ten rows (row_no, cells array) of each sheet that names a column, else 0."""
    joined = F.lower(F.array_join("cells", " "))
    hit = joined.rlike("requirement|description|standard|clause") & (F.col("row_no") < 10)
    return cells.groupBy(*by).agg(F.coalesce(F.min(F.when(hit, F.col("row_no"))), F.lit(0)).alias("header"))


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of a saved cache, the newest of each key; a missing or unreadable cache is empty."""
    files = spark.read.schema(f"{schema}, saved long").option("mode", "DROPMALFORMED").option("ignoreMissingFiles", True)
    try:
        rows = files.json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    names = [c for c in rows.columns if c not in ("key", "saved")]
    newest = rows.where("key is not null").groupBy("key").agg(F.max_by(F.struct(*names), "saved").alias("v"))
    return newest.select("key", "v.*")


def read_feedback(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines; malformed lines are skipped and missing fields are null."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path)


def read_groups(spark: SparkSession, path: str, most: int = 50, array: bool = False) -> DataFrame:
    """Clauses of the first groups of a group report, of JSON lines or (array) of files that hold one array."""
    groups = spark.read.schema(GROUPS).option("multiLine", array).json(path)
    return groups.orderBy("group_id").limit(most).select("group_id", F.posexplode("clauses").alias("pos", "c")).select("group_id", "pos", "c.*")


def read_projects(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The project index, newest first; with lines, of several objects, one in each line."""
    schema = "projects array<struct<id: string, name: string, created_at: string, last_modified: string, standards_count: int, requirements_count: int>>"
    return spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.inline("projects")).orderBy(F.desc("last_modified"), "id")


def read_project(spark: SparkSession, path: str, records: T.StructType | str, lines: bool = False) -> DataFrame:
    """Rows of project files, whose source data are a JSON string of records inside JSON; with lines, a project in each line."""
    schema = "metadata struct<id: string, name: string>, source_data struct<dataframe_json: string>"
    given = spark.read.schema(schema).option("multiLine", not lines).json(path)
    kind = records if isinstance(records, str) else records.simpleString()
    return given.select("metadata.id", F.inline(F.from_json("source_data.dataframe_json", f"array<{kind}>")))


def extract_files(files: DataFrame, readers: list[tuple[str, str, Callable[[bytes], str | None]]], least: int = 100) -> DataFrame:
    """Text of binaryFile rows by the first reader that gives more than `least` characters.

    readers: (method, confidence, bytes -> text) in order of preference, the last being text
    recognition; files that aren't PDF fail as unsupported. A reader that raises counts as silent.
    """
    schema = "path string, raw_text string, method string, success boolean, confidence string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                row = (path, None, None, False, None, "unsupported")
                if path.lower().endswith(".pdf"):
                    row = (path, None, None, False, None, "no text found")
                    for method, confidence, reader in readers:
                        try:
                            text = reader(content)
                        except Exception:  # noqa: BLE001  readers are foreign code; the next one has its turn
                            text = None
                        if text and len(text.strip()) > least:
                            row = (path, text, method, True, confidence, None)
                            break
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "raw_text", "method", "success", "confidence", "error"])

    return files.select("path", "content").mapInPandas(run, schema)
