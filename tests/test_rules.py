"""Hand-computed cases of the scalar rules and their quirks."""

import pytest
from pyspark.sql import functions as F

from clauseworks.functions import text as r
from clauseworks.functions.dialect import SPARK as D


def value(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns)).select(F.expr(expression)).first()[0]


@pytest.mark.parametrize(
    ("line", "expected"),
    [("7 Marking and instructions", True), ("7.1 General", True), ("A.2 Annex", True), ("VII.4 Operation", True), ("SAFETY INFORMATION", True), ("ABC", False), ("", False), ("  ", False), ("14", False), ("plain text", False), ("1.2(a) User", True), ("A" * 80, False)],
)
def test_heading(spark, line, expected):
    assert value(spark, r.is_heading(D, "t"), t=line) is expected


@pytest.mark.parametrize(("text", "expected"), [("1.7.4.1 x", "1.7.4.1"), ("A.2.3", "A.2.3"), ("VII.4", "VII.4"), ("1.2(a) user", "1.2"), ("none", ""), ("  7 x", "7")])
def test_clause_number(spark, text, expected):
    assert value(spark, r.clause_number(D, "t"), t=text) == expected


@pytest.mark.parametrize(
    ("clause", "expected"),
    [("5.101.1", "5.101"), ("BB.1.1", "BB.1"), ("46.8", "46.8"), ("5", "5"), ("Annex gg", "Annex GG"), ("Table GG.1", "Table GG"), ("annex", "Annex"), ("bibliography", "Bibliography"), ("(a)", None), ("5.101.1.a", "5.101"), ("7.1a", "7.1")],
)
def test_parent_section(spark, clause, expected):
    assert value(spark, r.parent_section(D, "c"), c=clause) == expected


@pytest.mark.parametrize(
    ("line", "expected"),
    [("redrO .oN 779474", True), (",779474", True), ("7.1 Addition: of dna", False), ("one fo two", True), ("ordinary line of text", False), ("a,b;c.", True), ("x" * 101, True), ("– 13 – EVS-EN", True), (".oN", True), ("", False)],
)
def test_garbage(spark, line, expected):
    assert value(spark, r.is_garbage(D, "t"), t=line) is expected


@pytest.mark.parametrize(("text", "expected"), [("WARNING: fire", True), ("The warning light", False), ("note this", True), ("calm", False)])
def test_warning_token(spark, text, expected):
    assert value(spark, r.warning_token(D, "t"), t=text) is expected


def test_scope_and_formatting(spark):
    assert value(spark, r.scope(D, "t"), t="A pedelec bicycle with a charger and battery") == "battery, bicycle, charger, ebike"
    assert value(spark, r.formatting(D, "t"), t="It shall be clearly legible and Shall be permanent") == "shall be clearly legible; Shall be permanent"
    assert value(spark, r.formatting(D, "t"), t="none") == "N/A"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("User manual with charging temperature", "battery_charging_and_storage"),
        ("user manual", "user_documentation_and_instructions"),
        ("The label", "labeling_and_warnings"),
        ("overcurrent protection device", "electrical_safety_and_insulation"),
        ("protection circuit", "battery_design_and_construction"),
        ("overcharge", "protection_circuits_and_bms"),
        ("hello", "miscellaneous_or_uncategorized"),
    ],
)
def test_category_order(spark, text, expected):
    assert value(spark, r.category("t"), t=text) == expected


@pytest.mark.parametrize(
    ("clause", "text", "expected"),
    [("7.1", "rated voltage label", "performance_limits"), ("2.4", "anything", "normative_references"), ("1.2", "scope", "scope"), ("9", "scope", "misc"), ("5", "shall be so constructed", "construction_requirements"), ("5", "dispose of the marked pack", "disposal_recycling")],
)
def test_requirement_type(spark, clause, text, expected):
    assert value(spark, r.requirement_type("c", "t"), c=clause, t=text) == expected


def test_validation(spark):
    assert value(spark, r.removal_reason(D, "t"), t="n/a") == "N/A placeholder"
    assert value(spark, r.removal_reason(D, "t"), t=" short ") == "Too short or lacks substance (5 chars)"
    assert value(spark, r.removal_reason(D, "t"), t="long enough text") is None
    assert value(spark, r.clause_type(D, "c", "t"), c="3.1", t="a total of ampere-hours") == "Definition"
    assert value(spark, r.clause_type(D, "c", "t"), c="3.1", t="it shall hold") == "Requirement"
    assert value(spark, r.clause_type(D, "c", "t"), c="9", t="Number of samples: 5") == "Test_Methodology"
    assert value(spark, r.clause_type(D, "c", "t"), c="9", t="See Annex B.") == "Preamble"


def test_requirement_id(spark):
    got = value(spark, r.requirement_id(D, "s", "c", "t"), s="EN 15194:2017", c="7.1.2(a)", t="  Text  ")
    assert got.startswith("EN15194201_7.1.2a_")
    assert len(got.rsplit("_", 1)[1]) == 6


def test_normal_clause_and_html(spark):
    assert value(spark, r.normal_clause("c"), c="7.1(a)") == "7.1.a"
    assert value(spark, r.escaped_html("t"), t="<a & 'b'>\n") == "&lt;a &amp; &#x27;b&#x27;&gt;<br>"


@pytest.mark.parametrize("rule, word", [(r.parent_section(D, "t"), "regexp_replace("), (r.category("t"), "lower("), (r.is_garbage(D, D.strip("t")), "regexp_replace("), (r.clause_number(D, "t"), "regexp_replace(")])
def test_rules_compute_what_they_name_often_once(spark, rule, word):
    plan = spark.createDataFrame([("7.1 a",)], "t string").selectExpr(f"{rule} as x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(word) == 1
