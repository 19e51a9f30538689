"""Lines and clauses made of the whole texts of documents, with phrases that meet the rules mixed in.

The documents hardly ever hold a keyword, so a phrase stands before each of their lines. Spark and
DuckDB build the tables alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauseworks.functions.dialect import SPARK, Spark, run

#: More than a document has lines.
CLAUSES_PER_DOCUMENT = 1_000_000

PHRASES = [
    "7 Marking and instructions",
    "7.1 General provisions apply here",
    "7.1.2 Instructions for use of the pack",
    "A.2 Annex material",
    "VII.4 Operating instructions",
    "SAFETY INFORMATION",
    "1.2(a) User information",
    "Contents of part ........ 12",
    "14",
    "EN 15194:2017",
    "",
    "The battery pack shall be marked with rated voltage and a legible label.",
    "Instructions for use shall include charging temperature limits and storage conditions.",
    "User manual should state ambient temperature and relative humidity limits.",
    "WARNING: risk of fire, do not open the enclosure.",
    "The warning light and audible warning device may be provided.",
    "CAUTION: keep away from heat, see Figure 7.2 for the symbol.",
    "A drop test and vibration exposure is performed; no fire shall occur.",
    "The following test shall be carried out on five samples.",
    "Insulation resistance and dielectric strength must exceed the limits.",
    "BMS overcharge protection is required for each cell.",
    "Test T.5: Connect supply and measure voltage",
    "Number of samples: 5",
    "N/A",
    "See Annex B.",
    "This clause of ISO 1 is applicable.",
    "capacity total number of ampere-hours withdrawn from a fully charged unit",
    "a) charger connector orientation and mass",
    "b) stability while parked",
    "c) manual transmission adjustment limits",
    "Dispose of the unit per WEEE recycling rules.",
    "Packaging shall withstand transport and shipping loads.",
    "Documentation shall accompany the product in print on paper copy.",
    "shall be made available to riders of an electric bicycle",
    "redrO .oN 779474",
    ",779474",
    "Temperature 25 °C and width 10 mm or 4 cm",
    "Enclosures shall be so constructed that ingress protection holds.",
    "This standard applies to pedelec bicycles; scope.",
    "The fuse and circuit breaker ratings, rated current 5 A",
    "In accordance with 5.2 unless otherwise specified.",
]


def lines_sql(d: Spark, documents: str) -> str:
    """(doc_id, standard_name, lineno, t): every line of every document, a phrase before each."""
    at = f"((doc_id * 7 + (pos + 1) * (1 + doc_id % 5) + (doc_id * (pos + 1)) % 3) % {len(PHRASES)})"
    raw = d.lines("text", "doc_id, standard_name", f"(select doc_id, source as standard_name, text from {documents})")
    return f"(select doc_id, standard_name, pos * 2 + 1 as lineno, {d.element(PHRASES, at)} as t from {raw} as s union all select doc_id, standard_name, pos * 2 + 2 as lineno, raw as t from {raw} as s)"


def clauses_sql(d: Spark, documents: str) -> str:
    """(clause_idx, doc_id, standard_name, clause_number, text): a clause for every line of every document, a phrase and the whole line."""
    at = f"((doc_id * 7 + doc_id % 3 + pos * 5) % {len(PHRASES)})"
    return (
        f"(select doc_id * {CLAUSES_PER_DOCUMENT} + pos as clause_idx, doc_id, standard_name, cast(1 + (doc_id + pos) % 9 as string) || '.' || cast(1 + doc_id % 12 as string) as clause_number, "
        f"{d.element(PHRASES, at)} || ' ' || raw as text from {d.lines('text', 'doc_id, standard_name', f'(select doc_id, source as standard_name, text from {documents})')} as s)"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(f"select * from {lines_sql(SPARK, '<documents>')}", documents=documents(spark, sf_dir))


def fx_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(f"select * from {clauses_sql(SPARK, '<documents>')}", documents=documents(spark, sf_dir))
