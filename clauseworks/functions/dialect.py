"""SQL fragments that Spark and DuckDB spell differently.

Operators are written once as SQL over these fragments: Spark runs them, DuckDB checks them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import DataFrame


_NAMES = count()


class Spark:
    """Fragments for Spark SQL."""

    name = "spark"

    def let(self, x: str, body: Callable[[str], str]) -> str:
        """body(name) with x under a name, so that a rule which says it often computes it once for a row.

        A column of an inner query would be put back into each place (filters are), and a rule of many
        branches outgrow a generated method.
        """
        name = f"let{next(_NAMES)}"
        return f"element_at(transform(array({x}), {name} -> {body(name)}), 1)"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.lit(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)})"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.lit(pattern)})"

    def listagg(self, x: str, sep: str, order: str, where: str = "") -> str:
        return f"listagg({x}, {self.lit(sep)}) within group (order by {order})" + (f" filter (where {where})" if where else "")

    def distinct_list(self, x: str, sep: str) -> str:
        """Sorted distinct values, joined."""
        return f"array_join(array_sort(collect_set({x})), {self.lit(sep)})"

    def lines(self, x: str, more: str, table: str) -> str:
        """A row (pos from 0, raw) for each line of x, with the columns `more`."""
        return f"(select {more}, pos, col as raw from (select {more}, posexplode(split({x}, '\\\\n', -1)) from {table}))"

    def series(self, upto: str, more: str, table: str) -> str:
        """Rows with k from 0 below upto."""
        return f"(select {more}, explode(sequence(0, cast({upto} as int) - 1)) as k from {table} where {upto} > 0)"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p}D)"

    def split_part(self, x: str, sep: str, i: int) -> str:
        return f"split_part({x}, {self.lit(sep)}, {i})"

    def element(self, values: Sequence[str], i: str) -> str:
        """values[i], i from 0."""
        return f"element_at(array({', '.join(map(self.lit, values))}), cast({i} as int) + 1)"

    def words(self, x: str) -> str:
        """The number of words between white space."""
        return f"size(filter(split({x}, '\\\\s+'), w -> w <> ''))"

    def strip(self, x: str) -> str:
        return self.replace(x, r"^\s+|\s+$", "")


class Duck(Spark):
    """Fragments for DuckDB."""

    name = "duckdb"

    def let(self, x: str, body: Callable[[str], str]) -> str:
        return body(x)

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def count(self, x: str, pattern: str) -> str:
        return f"cast(len(regexp_extract_all({x}, {self.lit(pattern)})) as int)"

    def listagg(self, x: str, sep: str, order: str, where: str = "") -> str:
        return f"string_agg({x}, {self.lit(sep)} order by {order})" + (f" filter (where {where})" if where else "")

    def distinct_list(self, x: str, sep: str) -> str:
        return f"coalesce(array_to_string(list_sort(list_distinct(list({x}))), {self.lit(sep)}), '')"

    def lines(self, x: str, more: str, table: str) -> str:
        return f"(select {more}, cast(unnest(range(len(l))) as int) as pos, unnest(l) as raw from (select {more}, string_split({x}, chr(10)) as l from {table}))"

    def series(self, upto: str, more: str, table: str) -> str:
        return f"(select {more}, cast(unnest(range(cast({upto} as int))) as int) as k from {table} where {upto} > 0)"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def split_part(self, x: str, sep: str, i: int) -> str:
        return f"split_part({x}, {self.lit(sep)}, {i})"

    def element(self, values: Sequence[str], i: str) -> str:
        return f"([{', '.join(map(self.lit, values))}])[cast({i} as int) + 1]"

    def words(self, x: str) -> str:
        return f"cast(len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')) as int)"


SPARK, DUCK = Spark(), Duck()


def run(sql: str, **tables: DataFrame) -> DataFrame:
    """Spark SQL over data frames: a name in the text stands for the frame given under it."""
    spark = next(iter(tables.values())).sparkSession
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = text.replace(f"<{name}>", "{" + name + "}")
    return spark.sql(text, **tables)


def any_of(x: str, words: Sequence[str]) -> str:
    """x (lower-cased already) holds one of the words as a substring."""
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


def any_like(d: Spark, x: str, patterns: Sequence[str], flags: str = "") -> str:
    return "(" + " or ".join(d.like(x, flags + p) for p in patterns) + ")"


def first_rule(rules: Sequence[tuple[str, str]], otherwise: str) -> str:
    """The result of the first condition that holds."""
    return "case " + " ".join(f"when {c} then {r}" for c, r in rules) + f" else {otherwise} end"
