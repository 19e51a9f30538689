"""Scalar rules over one text, as SQL expressions for either engine."""

from __future__ import annotations

from clauseworks.functions import fixed as v
from clauseworks.functions.dialect import SPARK, Spark, any_like, any_of, first_rule

I = "(?i)"


def is_heading(d: Spark, t: str) -> str:
    """Numbered in one of five ways, or in capitals with 4 to 79 characters; blank lines never are."""
    capitals = lambda s: f"(upper({s}) = {s} and lower({s}) <> {s} and length({s}) > 3 and length({s}) < 80)"
    return d.let(d.strip(t), lambda s: f"({s} <> '' and ({any_like(d, s, v.HEADING_PATTERNS)} or {capitals(s)}))")


def clause_number(d: Spark, t: str) -> str:
    """The first numbering scheme that the text starts with, else ''."""
    return d.let(d.strip(t), lambda s: "coalesce(" + ", ".join(f"nullif({d.extract(s, p)}, '')" for p in v.CLAUSE_NUMBER_PATTERNS) + ", '')")


def broad_clause_number(d: Spark, t: str) -> str:
    """clause_number, else any leading capitals and digits with what follows them, else Unknown."""
    loose = f"rtrim({d.extract(d.strip(t), v.BROAD_CLAUSE_NUMBER, 1)}, '.')" if d.name == "duckdb" else f"rtrim('.', {d.extract(d.strip(t), v.BROAD_CLAUSE_NUMBER, 1)})"
    return f"coalesce(nullif({clause_number(d, t)}, ''), nullif({loose}, ''), 'Unknown')"


def is_noise(d: Spark, t: str) -> str:
    """Blank, of a table of contents, a page number, or a reference to a standard."""
    return d.let(d.strip(t), lambda s: f"({s} = '' or {any_like(d, s, [v.TOC_LINE, v.PAGE_NUMBER, v.STANDARD_REFERENCE])})")


def is_garbage(d: Spark, s: str) -> str:
    """Headers, footers and reversed words; a subsection mark is never garbage."""
    return d.let(s, lambda x: _garbage(d, x))


def _garbage(d: Spark, s: str) -> str:
    marks, words = d.count(s, "[.,;:]"), d.count(s, r"\w+")
    bad = [d.like(s, v.REVERSED_AFTER_DOT), d.like(s, r"\b(" + "|".join(v.REVERSED_WORDS) + r")\b"), d.like(s, v.REVERSED_PHRASES), f"({words} > 0 and {marks} > 0.5 * {words})", f"(length({s}) > 100 and not contains({s}, ' '))"]
    bad += [d.like(s, p) for p in v.GARBAGE_PATTERNS]
    return f"({s} <> '' and not {d.like(s, v.SUBSECTION_MARK)} and ({' or '.join(bad)}))"


def hard_requirement(d: Spark, t: str) -> str:
    return any_like(d, t, v.HARD_REQUIREMENT_PATTERNS, I)


def soft_requirement(d: Spark, t: str) -> str:
    return any_like(d, t, v.SOFT_REQUIREMENT_PATTERNS, I)


def warning_token(d: Spark, t: str) -> str:
    """A word of warning that isn't about a warning device."""
    return f"({any_like(d, t, v.WARNING_PATTERNS, I)} and not {any_like(d, f'lower({t})', v.WARNING_EXCLUSION_PATTERNS)})"


def scope(d: Spark, t: str) -> str:
    """The product words that occur, in order of the alphabet."""
    parts = lambda x: ", ".join(f"case when {any_like(d, x, p)} then '{k}' end" for k, p in sorted(v.SCOPE_PATTERNS.items()))
    return d.let(f"lower({t})", lambda x: f"concat_ws(', ', {parts(x)})")


def formatting(d: Spark, t: str) -> str:
    parts = ", ".join(f"nullif({d.extract(t, I + p)}, '')" for p in v.FORMATTING_PATTERNS)
    return f"coalesce(nullif(concat_ws('; ', {parts}), ''), 'N/A')"


def in_print(d: Spark, t: str, section: str, warning: str | None = None) -> str:
    """y if print is named, a warning is given, or (section) the item comes from an instructions section; warning may name a column that knows."""
    return f"case when {any_like(d, f'lower({t})', v.PRINT_REQUIREMENT_PATTERNS)} or {warning or warning_token(d, t)} or {section} then 'y' else 'n' end"


def parent_section(d: Spark, c: str) -> str:
    """Annex and table names; else the first two numeric or lettered segments; null if there is none."""
    return d.let(d.strip(c), lambda s: _parent_section(d, s))


def _parent_section(d: Spark, s: str) -> str:
    named = [
        (f"starts_with(lower({s}), '{k}')" if d.name == "duckdb" else f"startswith(lower({s}), '{k}')", f"case when {d.like(s, I + '^' + k + r'\s+[A-Z]{1,2}')} then '{k.title()} ' || upper({d.extract(s, I + '^' + k + r'\s+([A-Z]{1,2})', 1)}) else '{k.title()}' end")
        for k in ("annex", "table")
    ]
    segments = [d.extract(d.split_part(s, ".", i), r"^(\d+|[A-Z]{1,2})", 1) for i in range(1, 9)]
    kept = f"concat_ws('.', {', '.join(f'nullif({x}, {chr(39) * 2})' for x in segments)})"
    two = d.let(kept, lambda k: f"case when contains({k}, '.') then {d.split_part(k, '.', 1)} || '.' || {d.split_part(k, '.', 2)} else nullif({k}, '') end")
    return first_rule([*named, (f"lower({s}) = 'bibliography'", "'Bibliography'")], two)


def is_placeholder(d: Spark, t: str) -> str:
    return f"(upper({d.strip(t)}) in ({', '.join(map(d.lit, v.PLACEHOLDERS))}))"


def has_substance(d: Spark, t: str) -> str:
    """At least ten characters and two words."""
    return f"(length({d.strip(t)}) >= 10 and {d.words(t)} >= 2)"


def is_preamble(d: Spark, t: str) -> str:
    return any_like(d, d.strip(t), v.PREAMBLE_PATTERNS, I)


def is_definition(d: Spark, c: str, t: str) -> str:
    """In section 3 and without any word of a requirement."""
    return f"({d.like(d.strip(c), r'^3(\.\d+)*$')} and not {any_of(f'lower({t})', v.REQUIRED_KEYWORDS)})"


def is_test_method(d: Spark, t: str) -> str:
    return f"(not {any_of(f'lower({t})', v.REQUIRED_KEYWORDS)} and {any_like(d, t, v.TEST_PATTERNS, I)})"


def clean_comment(d: Spark, x: str) -> str:
    s = d.strip(x)
    return f"case when lower({s}) in ({', '.join(map(d.lit, v.EXTRACTION_NOTES))}) or upper({s}) in ('N/A', 'NA') then '' else {x} end"


def mandate_level(t: str) -> str:
    x = f"lower({t})"
    return first_rule([(any_of(x, ["shall", "must", "required"]), "'High'"), (any_of(x, ["should", "recommended"]), "'Medium'")], "'Informative'")


def flag(t: str, words: list[str]) -> str:
    return f"case when {any_of(f'lower({t})', words)} then 'y' else 'n' end"


def safety_flag(t: str) -> str:
    return flag(t, v.SAFETY_KEYWORDS)


def manual_flag(t: str) -> str:
    return flag(t, v.MANUAL_KEYWORDS)


def clause_type(d: Spark, c: str, t: str) -> str:
    return first_rule([(is_preamble(d, t), "'Preamble'"), (is_definition(d, c, t), "'Definition'"), (is_test_method(d, t), "'Test_Methodology'")], "'Requirement'")


def removal_reason(d: Spark, t: str) -> str:
    """Why a requirement is removed; null if it stays."""
    return first_rule([(is_placeholder(d, t), "'N/A placeholder'"), (f"not {has_substance(d, t)}", f"'Too short or lacks substance (' || cast(length({d.strip(t)}) as string) || ' chars)'")], "null")


def row_scope(t: str) -> str:
    x = f"lower({t})"
    return first_rule([(any_of(x, ["manual", "instruction", "document"]), "'Documentation'"), (any_of(x, ["marking", "label", "symbol"]), "'Marking/Labeling'"), (any_of(x, ["warning", "caution", "danger"]), "'Safety Notice'")], "''")


def row_formatting(t: str) -> str:
    return f"case when {any_of(f'lower({t})', ['bold', 'font', 'size', 'color', 'symbol'])} then 'Yes' else 'N/A' end"


def row_print(t: str) -> str:
    return flag(t, ["manual", "instruction", "document", "warning", "caution"])


def row_image(t: str) -> str:
    return f"case when {any_of(f'lower({t})', ['figure', 'symbol', 'pictogram', 'icon', 'diagram'])} then 'Possible' else 'N' end"


def row_notice(t: str) -> str:
    return first_rule([(any_of(f"lower({t})", [k.lower()]), f"'{k}'") for k in ("Danger", "Warning", "Caution")], "'None'")


def context_comment(t: str, parent: str) -> str:
    """What kind of row this is: a header's kind, or the parent's kind and the first theme that the text names."""
    x = f"lower({t})"
    header = first_rule([(any_of(x, ["general", "requirements"]), "'Section header - specific requirements in subsections'"), (any_of(x, ["test"]), "'Test section header - specific test procedures in subsections'"), (any_of(x, ["annex", "informative"]), f"'Reference section in ' || {parent}")], "'Section header only - detailed content in subsections'")
    prefix = first_rule([(f"{parent} like 'Annex BB%'", "'Normative annex - '"), (f"{parent} like 'Annex%'", "'Informative annex - '"), (f"{parent} = '2. Normative references'", "'Normative reference - '"), (f"{parent} = '3. Terms and definitions'", "'Definition - '")], "''")
    both = lambda a, b: f"({any_of(x, [a])} and {any_of(x, b)})"
    theme = first_rule(
        [
            (any_of(x, ["marking", "label"]), "'Marking and labeling requirements'"),
            (any_of(x, ["instruction", "manual", "document"]), "'Documentation and instruction requirements'"),
            (both("test", ["procedure"]), "'Test procedure specification'"),
            (both("test", ["shall", "requirement"]), "'Test requirement and acceptance criteria'"),
            (any_of(x, ["warning", "caution", "danger"]), "'Safety notice and warning requirements'"),
            (any_of(x, ["symbol", "graphical"]), "'Graphical symbol requirements'"),
            (any_of(x, ["shall", "must"]), "'Compliance requirement'"),
            (any_of(x, ["purpose"]), "'Test purpose and objective'"),
            (any_of(x, ["applicable"]), "'Applicability statement'"),
        ],
        "'Requirement specification'",
    )
    return f"case when length({t}) < 100 and not {any_of(x, ['shall', 'must', 'required'])} then {header} else {prefix} || {theme} end"


def image_reference(d: Spark, t: str) -> str:
    """The text of the first kind of reference to an image, else ''."""
    return "coalesce(" + ", ".join(f"nullif({d.extract(t, p)}, '')" for p in v.IMAGE_PATTERNS) + ", '')"


def safety_notice(t: str) -> str:
    return first_rule([(f"contains(upper({t}), '{k}')", f"'{k}'") for k in v.NOTICES], "'None'")


def requirement_id(d: Spark, standard: str, clause: str, text: str) -> str:
    """Prefix of the standard, clause, and six digits of a digest of the text's first 100 characters."""
    digest = f"md5(substring(lower({d.strip(text)}), 1, 100))"
    return f"substring({d.replace(standard, '[^\\p{L}\\p{N}]', '')}, 1, 10) || '_' || {d.replace(d.strip(clause), '[^\\p{L}\\p{N}.]', '')} || '_' || substring({digest}, 1, 6)"


def category(t: str, d: Spark = SPARK) -> str:
    """The first category whose keywords occur; documents about charging are a category of their own."""
    return d.let(f"lower({t})", _category)


def _category(x: str) -> str:
    charging = any_of(x, v.CHARGING_KEYWORDS)
    docs = (any_of(x, v.DOCUMENT_KEYWORDS), f"case when {charging} then 'battery_charging_and_storage' else 'user_documentation_and_instructions' end")
    return first_rule([docs, *((any_of(x, words), f"'{k}'") for k, words in v.CATEGORY_KEYWORDS.items())], "'miscellaneous_or_uncategorized'")


def category_title(d: Spark, c: str) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then {d.lit(t)}" for k, t in v.CATEGORY_TITLES.items()) + " end"


def requirement_type(c: str, t: str, d: Spark = SPARK) -> str:
    """The first type whose keywords occur; section numbers 1, 2 and 3 count as words of theirs."""
    return d.let(f"lower({t})", lambda x: d.let(f"lower(coalesce({c}, ''))", lambda n: _requirement_type(x, n)))


def _requirement_type(x: str, n: str) -> str:
    first = [
        (f"({any_of(x, ['normative reference'])} or {n} like '2.%')", "'normative_references'"),
        (f"({any_of(x, ['terms and definitions', 'definition'])} or {n} like '3.%')", "'definitions'"),
        (f"({any_of(x, ['scope'])} and ({any_of(x, ['this standard', 'applies to'])} or {n} like '1.%'))", "'scope'"),
    ]
    return first_rule([*first, *((any_of(x, words), f"'{k}'") for k, words in v.REQUIREMENT_TYPE_KEYWORDS.items())], "'misc'")


def normal_clause(c: str) -> str:
    """Bracketed letters as segments: 7.1(a) becomes 7.1.a."""
    return f"case when contains({c}, '(') and contains({c}, ')') then replace(replace({c}, '(', '.'), ')', '') else {c} end"


def escaped_html(t: str) -> str:
    """&, <, >, quotes as entities, and line breaks."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        t = f"replace({t}, '{a}', '{b}')" if a != "''" else f"replace({t}, chr(39), '{b}')"
    return f"replace({t}, chr(10), '<br>')"
