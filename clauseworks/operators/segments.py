"""Documents into lines, sections, paragraphs, items and clauses.

Inputs are line tables (doc_id, lineno from 1, t); every window and join is keyed by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from clauseworks.functions import fixed as v
from clauseworks.functions import text as r
from clauseworks.functions.dialect import SPARK, Spark, any_like, run
from clauseworks.runtime import materialize

PAGE_LINES, LEAST_SECTIONS = 50, 5
LEAST_CHARS, MOST_CHARS = 200, 5000
#: Lines of a block, by which lines and the ranges that hold them are joined.
BLOCK_LINES = 256


def split_lines_sql(d: Spark, documents: str, text: str = "text") -> str:
    """A row for each line of a text, numbered from 1; trailing empty lines count."""
    return f"select doc_id, pos + 1 as lineno, raw as t from {d.lines(text, 'doc_id', documents)} as s"


def all_sections_sql(d: Spark, lines: str) -> str:
    """From one heading to the next; documents with few sections are split by pages instead."""
    s = d.strip("t")
    return f"""
with l as (
  select doc_id, lineno, {s} as s, t, case when {any_like(d, s, v.GENERIC_HEADING_PATTERNS, '(?i)')} then 1 else 0 end as h from {lines} as x
), islands as (
  select *, sum(h) over (partition by doc_id order by lineno) as island, max(lineno) over (partition by doc_id) as final from l
), sections as (
  select doc_id, min(lineno) as start_line, case when min(lineno) = max(final) then null else max(lineno) end as end_line,
         min_by(s, lineno) as heading, {d.listagg('s', chr(10), 'lineno')} as content
  from islands where island > 0 group by doc_id, island
), few as (
  select d.doc_id from (select distinct doc_id from l) d left join sections s on s.doc_id = d.doc_id group by d.doc_id having count(s.doc_id) < {LEAST_SECTIONS}
), pages as (
  select l.doc_id, cast(floor((lineno - 1) / {PAGE_LINES}) as int) + 1 as page, lineno, t from l join few on few.doc_id = l.doc_id
)
select s.doc_id, start_line, end_line, heading, {r.broad_clause_number(d, 'heading')} as clause_number, content
from sections s left join few f on f.doc_id = s.doc_id where f.doc_id is null
union all
select doc_id, min(lineno), max(lineno), 'Page ' || cast(page as string), 'Page ' || cast(page as string), {d.listagg('t', chr(10), 'lineno')} from pages group by doc_id, page
"""


def page_split_sql(d: Spark, lines: str) -> str:
    """Pages of a fixed number of lines."""
    return f"""
select doc_id, page, min(lineno) as start_line, max(lineno) as end_line, {d.listagg('t', chr(10), 'lineno')} as content
from (select doc_id, cast(floor((lineno - 1) / {PAGE_LINES}) as int) + 1 as page, lineno, t from {lines} as x) group by doc_id, page
"""


def ruled_sql(d: Spark, lines: str) -> str:
    """Lines, stripped (s), with what sections are made of: heading (h), noise, clause number (c) and the document's last line (final)."""
    return f"""select doc_id, lineno, {d.strip("t")} as s, {r.is_heading(d, 't')} as h, {r.is_noise(d, 't')} as noise, {r.clause_number(d, 't')} as c,
         max(lineno) over (partition by doc_id) as final from {lines} as x"""


def ruled(lines: DataFrame) -> DataFrame:
    """ruled_sql, written once: sections read it in several branches, and its rules are dear."""
    return materialize(run(ruled_sql(SPARK, "<lines>"), lines=lines), "ruled")


def manual_sections_sql(d: Spark, lines: str, extra: tuple[str, ...] = (), rules: str = "") -> str:
    """G1: from a heading about manuals to the line before the first later heading of another top-level number.

    Sections may overlap. Both clause numbers must be there for a section to end before the last line. `rules`
    names a table of ruled, if it is there.
    """
    names = " or ".join([any_like(d, "lower(s)", v.MANUAL_SECTION_PATTERNS, "(?i)"), *(f"contains(lower(s), {d.lit(x.lower())})" for x in extra)])
    begins = f"h and ({names}) and not {d.like('s', v.TOC_LINE)}"
    top = lambda c: d.split_part(c, ".", 1)
    if d.name == "duckdb":
        ended = f"""ended as (
  select b.doc_id, b.lineno, min(n.lineno) - 1 as stop from begun b join l n on n.doc_id = b.doc_id and n.lineno > b.lineno
  where n.h and not n.noise and n.c <> '' and b.c <> '' and {top('b.c')} <> {top('n.c')} and not starts_with(n.c, b.c) group by b.doc_id, b.lineno
)"""
    else:
        later = "over (partition by doc_id, k order by lineno desc rows between unbounded preceding and 1 preceding)"
        ended = f"""widths as (
  select distinct doc_id, {_key_width('c')} as k from begun where c <> ''
), marks as (
  select l.doc_id, l.lineno, k, not noise as ends, begins and {_key_width('c')} = k as begins, if(k = 0, {top('c')}, left({top('c')}, k)) as key
  from (select *, {begins} as begins from l where h and c <> '') l join widths w on w.doc_id = l.doc_id where not noise or begins
), nexts as (
  select *, min(if(ends, lineno, null)) {later} as next_line, last(if(ends, key, null)) ignore nulls {later} as next_key from marks
), ended as (
  select doc_id, lineno, stop - 1 as stop
  from (select *, if(next_key <> key, next_line, last(if(ends and next_key <> key, next_line, null)) ignore nulls {later}) as stop from nexts) where begins and stop is not null
)"""
    return f"""
with l as (
  {f"select * from {rules}" if rules else ruled_sql(d, lines)}
), begun as (
  select * from l where {begins}
), {ended}, ranges as (
  select b.doc_id, b.lineno as start_line, coalesce(stop, final) as end_line, b.s as heading, b.c as clause_number
  from begun b left join ended e on e.doc_id = b.doc_id and e.lineno = b.lineno
)
select g.doc_id, start_line, end_line, heading, clause_number, {d.listagg('l.s', chr(10), 'l.lineno')} as content
from {within_sql(d, 'ranges', 'l')} and (not l.noise or l.lineno = g.start_line)
group by g.doc_id, start_line, end_line, heading, clause_number
"""


def _key_width(c: str) -> str:
    """0 for a clause number with a point, else its length.

    What ends a section differs from it in the part before the first point, or, where the section's number is
    only that part, in as many leading characters as the number has (1 doesn't end at 10).
    """
    return f"if(contains({c}, '.'), 0, length({c}))"


def within_sql(d: Spark, ranges: str, lines: str) -> str:
    """A join of ranges (as g: doc_id, start_line, end_line) with the lines (as l) they hold; more conditions may follow.

    Spark joins by blocks of lines, so a line meets only ranges that reach its block and a long document is dealt out.
    """
    if d.name == "duckdb":
        return f"{ranges} g join {lines} l on l.doc_id = g.doc_id and l.lineno between g.start_line and g.end_line"
    blocks = f"(select *, explode(sequence(start_line div {BLOCK_LINES}, end_line div {BLOCK_LINES})) as block from {ranges})"
    return f"{blocks} g join {lines} l on l.doc_id = g.doc_id and l.lineno div {BLOCK_LINES} = g.block and l.lineno between g.start_line and g.end_line"


def open_lines_sql(d: Spark, lines: str, sections: str) -> str:
    """Lines that no section (doc_id, start_line, end_line) holds.

    Spark takes the farthest end of the sections begun so far; each section begins at one of the lines.
    """
    if d.name == "duckdb":
        return f"select l.* from {lines} as l where not exists (select 1 from {sections} g where g.doc_id = l.doc_id and l.lineno between g.start_line and g.end_line)"
    return f"""
select * except (reach) from (
  select l.*, max(g.reach) over (partition by l.doc_id order by l.lineno) as reach
  from {lines} as l left join (select doc_id, start_line, max(end_line) as reach from {sections} as g group by doc_id, start_line) g on g.doc_id = l.doc_id and g.start_line = l.lineno
) where reach is null or reach < lineno"""


def clause_hits_sql(d: Spark, lines: str, sections: str = "") -> str:
    """Lines outside manual sections that hold a phrase about manuals, with two lines around them."""
    s = d.strip("t")
    low = f"lower({s})"
    hits = ", ".join(f"case when {d.like('s', '(?i)' + p)} then '{i}' end" for i, p in enumerate(v.CLAUSE_KEYWORD_PATTERNS))
    around = "over (partition by doc_id order by lineno rows between 2 preceding and 2 following)"
    context = f"string_agg(t, chr(10)) {around}" if d.name == "duckdb" else f"array_join(collect_list(t) {around}, '\\n')"
    return f"""
with sections as ({f"select * from {sections}" if sections else manual_sections_sql(d, lines)}), l as (
  select doc_id, lineno, t, {s} as s, {low} as low, {context} as context from {lines} as x
), open_lines as (
  {open_lines_sql(d, 'l', 'sections')}
)
select doc_id, lineno as line_number, s as text, matched, {r.clause_number(d, 's')} as clause_number, context
from (select *, concat_ws(',', {hits}) as matched from open_lines)
where length(s) >= 10 and matched <> ''
  and not ({d.like('s', r'(?i)\b(WARNING|CAUTION|DANGER)\b')} and {any_like(d, 'low', v.WARNING_EXCLUSION_PATTERNS)})
  and not (contains(low, 'manual') and {any_like(d, 'low', v.MANUAL_EXCLUSION_PATTERNS)})
"""


def paragraphs_sql(d: Spark, lines: str) -> str:
    """Runs of lines between blank ones; the end is the line before the blank, or the last line."""
    return f"""
select doc_id, min(lineno) as start_line, max(lineno) as end_line, {d.listagg('s', chr(10), 'lineno')} as text, min_by(h, lineno) as is_heading
from (select *, sum(case when s = '' then 1 else 0 end) over (partition by doc_id order by lineno) as island
      from (select doc_id, lineno, {d.strip('t')} as s, {r.is_heading(d, 't')} as h from {lines} as x))
where s <> '' group by doc_id, island
"""


ITEM_TAIL = r"\s*(?:Addition:|Replacement:|Amendment:|Modification:)?:?\s*"


def items_sql(d: Spark, sections: str, kind: str) -> str:
    """G8 (lettered), G9 (numbered): items of sections (doc_id, start_line, heading, clause_number, content).

    Text before the first item is an item of its own if more than 50 characters remain without the heading.
    """
    pattern = r"^([a-z]+)\)\s+" if kind == "lettered" else r"^(\d+\.\d+(?:\.\d+)*)" + ITEM_TAIL
    number = "mark || ')'" if kind == "lettered" else "mark"
    rest = d.replace("s", pattern, "")
    starts = "starts_with(intro, heading)" if d.name == "duckdb" else "startswith(intro, heading)"
    parent = "" if kind == "lettered" else "and clause_number <> ''"
    cut = d.strip(f"case when {starts} then substring(intro, length(heading) + 1) else intro end")
    if d.name == "duckdb":
        found_items = f""", intro as (
  select doc_id, start_line, end_line, heading, parent, {cut} as body
  from (select doc_id, start_line, end_line, heading, parent, body as intro from items where island = 0) i
  where exists (select 1 from items o where o.doc_id = i.doc_id and o.start_line = i.start_line and o.island > 0)
)
select doc_id, start_line, end_line, heading, cast(island as int) as item, {number} as clause_number, body as text from items where island > 0
union all
select doc_id, start_line, end_line, heading, 0, parent, body from intro where length(body) > 50
"""
    else:  # items are read once
        found_items = f"""
select doc_id, start_line, end_line, heading, cast(island as int) as item, if(island > 0, {number}, parent) as clause_number, if(island > 0, intro, body) as text
from (select *, {cut} as body from (select * except (body), body as intro, max(island) over (partition by doc_id, start_line) as top from items) where top > 0)
where island > 0 or length(body) > 50
"""
    return f"""
with l as (
  select * from (select doc_id, start_line, end_line, heading, clause_number, pos, {d.strip('raw')} as s from {d.lines('content', 'doc_id, start_line, end_line, heading, clause_number', sections)} as x)
  where s <> '' and not {r.is_garbage(d, 's')} {parent}
), marked as (
  select *, {d.extract('s', pattern, 1)} as found from l
), islands as (
  select *, sum(case when found <> '' then 1 else 0 end) over (partition by doc_id, start_line order by pos) as island from marked
), items as (
  select doc_id, start_line, max(end_line) as end_line, max(heading) as heading, max(clause_number) as parent, island, min_by(found, pos) as mark,
         {d.strip(d.listagg(f"case when found <> '' then {rest} else s end", chr(10), 'pos'))} as body
  from islands group by doc_id, start_line, island
){found_items}"""


def combined_sql(d: Spark, lines: str, given: str = "") -> str:
    """Of each manual section its numbered items, else its lettered ones, else its text without garbage; then clause hits."""
    keep = f"""select doc_id, start_line, end_line, heading, clause_number, coalesce({d.listagg('raw', chr(10), 'pos', f"{d.strip('raw')} <> '' and not {r.is_garbage(d, d.strip('raw'))}")}, '') as text
  from {d.lines('content', 'doc_id, start_line, end_line, heading, clause_number', 'sections')} as x group by doc_id, start_line, end_line, heading, clause_number"""
    none = lambda t: f"not exists (select 1 from {t} o where o.doc_id = s.doc_id and o.start_line = s.start_line)"
    lines_of = "cast(start_line as string) || '-' || cast(end_line as string)"
    return f"""
with sections as ({f"select * from {given}" if given else manual_sections_sql(d, lines)}), numbered as ({items_sql(d, 'sections', 'numbered')}), lettered as ({items_sql(d, 'sections', 'lettered')}), hits as ({clause_hits_sql(d, lines, given)}), plain as ({keep})
select doc_id, 'section' as source, {lines_of} as line_number, clause_number, heading, text, '' as matched from numbered
union all
select doc_id, 'section', {lines_of}, clause_number, heading, text, '' from lettered s where {none('numbered')}
union all
select doc_id, 'section', {lines_of}, clause_number, heading, text, '' from plain s where {none('numbered')} and {none('lettered')}
union all
select doc_id, 'clause', cast(line_number as string), clause_number, '', text, matched from hits
"""


BOUNDARIES = {
    # fixed values: what a clause may begin with, in manual sections and in all sections
    "manual": [r"^\d+(\.\d+)+\s", r"^\d+(\.\d+)*\([a-z]\)\s", r"^\([a-z]\)\s", r"^[a-z]\)\s"],
    "all": [r"^\d+(\.\d+)+\s", r"^\d+(\.\d+)*\([a-z]\)\s", r"^[A-Z](\.\d+)+\s", r"^[IVX]+\.\d+\s", r"^\([a-z]\)\s", r"^[a-z]\)\s", r"^\d+\)\s"],
}


def segment_lines_sql(d: Spark, lines: str, kind: str) -> str:
    """Lines with their chunk, and what a chunk's first line begins with (found; b = 1 if that is a boundary)."""
    found = "coalesce(" + ", ".join(f"nullif({d.strip(d.extract('s', p))}, '')" for p in BOUNDARIES[kind]) + ", '')"
    rest = d.strip("substring(s, length(found) + 1)")
    return f"""
with l as (
  select *, {found} as found, row_number() over (partition by doc_id order by lineno) as n from (select doc_id, lineno, t, {d.strip('t')} as s from {lines} as x)
), marked as (
  select *, case when n > 1 and found <> '' and length(rest) >= 10 and {d.like('rest', '^[A-Z0-9]')} then 1 else 0 end as b from (select *, {rest} as rest from l)
)
select doc_id, lineno, t, found, b, cast(sum(b) over (partition by doc_id order by lineno) as int) as chunk from marked
"""


def segments_sql(d: Spark, lines: str, kind: str = "manual") -> str:
    """Clauses of a text. A boundary needs ten more characters that begin with a capital or digit.

    The first line of a text never names its clause; blank lines are kept.
    """
    return f"""
select doc_id, chunk, min(lineno) as start_line, max(lineno) as end_line,
       case when max(b) = 1 then min_by(found, lineno) else 'N/A' end as clause_number, {d.listagg('t', chr(10), 'lineno')} as content
from ({segment_lines_sql(d, lines, kind)}) c group by doc_id, chunk
"""


def bounded_segments(lines: DataFrame, kind: str = "manual", most: int = 8000) -> DataFrame:
    """G11 with its limit: a chunk is closed once its quarter-lengths add up to more than `most`; parts keep the clause.

    The fold notes only the lines that close a part, so its work is linear in the lines of a chunk.
    """
    ordered = "partition by c.doc_id, c.chunk order by c.lineno"
    return run(
        f"""
with c as ({segment_lines_sql(SPARK, '<lines>', kind)}), closed as (
  select doc_id, explode(aggregate(array_sort(collect_list(struct(lineno, length(t) div 4 as n))), named_struct('sum', 0L, 'out', cast(array() as array<bigint>)),
    (a, x) -> if(a.sum + x.n > {most}, named_struct('sum', 0L, 'out', array_append(a.out, cast(x.lineno as bigint))), named_struct('sum', a.sum + x.n, 'out', a.out))).out) as lineno
  from c group by doc_id, chunk
), parts as (
  select c.doc_id, c.chunk, c.lineno, t, cast(count(p.lineno) over ({ordered} rows between unbounded preceding and 1 preceding) as int) as part, first(if(b = 1, found, 'N/A')) over ({ordered}) as clause_number
  from c left join closed p on p.doc_id = c.doc_id and p.lineno = c.lineno
)
select doc_id, chunk, part, clause_number, min(lineno) as start_line, max(lineno) as end_line, {SPARK.listagg('t', chr(10), 'lineno')} as content
from parts group by doc_id, chunk, part, clause_number
""",
        lines=lines,
    )


def merge_batches_sql(d: Spark, sections: str) -> str:
    """Batch of each section (doc_id, ord, n): small ones join until LEAST_CHARS, never beyond MOST_CHARS.

    A section of LEAST_CHARS closes its batch whatever came before, so Spark folds the runs between such sections
    one by one, noting only what begins a batch; the check walks all sections by a recursive query.
    """
    if d.name == "spark":
        begins = f"not a.started or a.size + x.n > {MOST_CHARS}"
        return f"""
with x as (
  select doc_id, cast(ord as int) as ord, cast(n as bigint) as n from {sections} as x
), runs as (
  select *, coalesce(sum(if(n >= {LEAST_CHARS}, 1, 0)) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0) as run from x
), begun as (
  select doc_id, explode(aggregate(array_sort(collect_list(struct(ord, n))), named_struct('size', 0L, 'started', false, 'out', cast(array() as array<int>)),
    (a, x) -> if({begins}, named_struct('size', x.n, 'started', x.n < {LEAST_CHARS}, 'out', array_append(a.out, x.ord)),
                 named_struct('size', a.size + x.n, 'started', a.size + x.n < {LEAST_CHARS}, 'out', a.out))).out) as ord
  from runs group by doc_id, run
)
select x.doc_id, x.ord, cast(count(b.ord) over (partition by x.doc_id order by x.ord) - 1 as int) as batch
from x left join begun b on b.doc_id = x.doc_id and b.ord = x.ord
"""
    return f"""
with recursive s as (select doc_id, cast(ord as int) as ord, n from {sections} as x), w(doc_id, ord, batch, next_batch, size, started) as (
  select doc_id, ord, 0, case when n >= {LEAST_CHARS} then 1 else 0 end, case when n >= {LEAST_CHARS} then 0 else n end, n < {LEAST_CHARS} from s where ord = 1
  union all
  select s.doc_id, s.ord, b.k, case when b.z >= {LEAST_CHARS} then b.k + 1 else b.k end, case when b.z >= {LEAST_CHARS} then 0 else b.z end, b.z < {LEAST_CHARS}
  from w join s on s.doc_id = w.doc_id and s.ord = w.ord + 1,
  lateral (select case when w.started and w.size + s.n > {MOST_CHARS} then w.next_batch + 1 else w.next_batch end as k, case when w.started and w.size + s.n > {MOST_CHARS} then s.n else w.size + s.n end as z) b
)
select doc_id, ord, batch from w
"""


def _of(name: str, sql):
    def operator(table: DataFrame, *args) -> DataFrame:
        return run(sql(SPARK, "<table>", *args), table=table)

    operator.__name__, operator.__doc__ = name, sql.__doc__
    return operator


split_lines = _of("split_lines", split_lines_sql)
all_sections = _of("all_sections", all_sections_sql)
page_split = _of("page_split", page_split_sql)


def manual_sections(lines: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """manual_sections_sql with the rules of the lines written once."""
    return run(manual_sections_sql(SPARK, "", extra, "<rules>"), rules=ruled(lines))


clause_hits = _of("clause_hits", clause_hits_sql)
paragraphs = _of("paragraphs", paragraphs_sql)
items = _of("items", items_sql)


def combined(lines: DataFrame) -> DataFrame:
    """combined_sql with the sections written once: each of its branches reads them."""
    return run(combined_sql(SPARK, "<lines>", "<sections>"), lines=lines, sections=materialize(manual_sections(lines), "sections"))


segments = _of("segments", segments_sql)
merge_batches = _of("merge_batches", merge_batches_sql)
