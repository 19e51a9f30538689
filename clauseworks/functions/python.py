"""The few rules that need Python: JSON repair, encoding repair, packing of sections, languages, model calls."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from clauseworks.functions.models import BYTES_AT_ONCE, ROWS_AT_ONCE, Policy, ask
from clauseworks.runtime import small_batches

# Garbled characters and what they stand for, in this order
GARBLED = [("Â°", "°"), ('â€"', "–"), ('â€"', "—"), ("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("Â ", " ")]
_QUOTED = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)"', re.S)


def fix_garbled(c: Column) -> Column:
    """P1 without the round trip: literal replacements, in the JVM."""
    for a, b in GARBLED:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@F.pandas_udf(StringType())
def fix_encoding(texts: pd.Series) -> pd.Series:
    """The replacements, then UTF-8 read as Latin-1 is read again where that is possible."""

    def fix(t: str | None) -> str | None:
        if not t:
            return t
        for a, b in GARBLED:
            t = t.replace(a, b)
        try:
            return t.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return t

    return texts.map(fix)


@F.pandas_udf(StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    """Without fences and trailing commas, with line breaks inside strings escaped."""

    def repair(t: str | None) -> str | None:
        if t is None:
            return None
        for fence in ("```json", "```"):
            if fence in t:
                t = t.split(fence)[1].split("```")[0].strip()
                break
        t = re.sub(r",(\s*)([}\]])", r"\2", t)
        return _QUOTED.sub(lambda m: m[0].replace("\n", "\\n"), t)

    return texts.map(repair)


def language_filter(probability: Callable[[str], float] | None = None, least_chars: int = 20, least: float = 0.8) -> Callable[[Column], Column]:
    """True for short texts, for English at the given probability, and wherever the detector is missing or fails."""
    if probability is None:
        return lambda c: F.lit(True)

    @F.pandas_udf(BooleanType())
    def english(texts: pd.Series) -> pd.Series:
        def keep(t: str | None) -> bool:
            if not t or len(t.strip()) < least_chars:
                return True
            try:
                return probability(t) >= least
            except Exception:  # noqa: BLE001  a detector that fails must not lose text
                return True

        return texts.map(keep)

    return english


def token_count(c: Column, tokenizer: Callable[[str], int] | None = None) -> Column:
    """The number of tokens by an injected tokenizer; where there is none or it fails, a token is four characters."""
    rough = F.floor(F.length(c) / 4)
    if tokenizer is None:
        return rough

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        def count(t: str | None) -> int | None:
            try:
                return None if t is None else tokenizer(t)
            except Exception:  # noqa: BLE001  the rough count stands in
                return None

        return texts.map(count).astype("Int64")

    return F.coalesce(counted(c), rough)


_HEADER = re.compile(r"\n(\d+(?:\.\d+)*)\s+[A-Z][^\n]{10,100}\n")


def window_starts(length: int, size: int, overlap: int) -> list[int]:
    """Starts of windows of `size` that overlap and reach the end."""
    return list(range(0, max(1, length - overlap), size - overlap)) if length > size else [0]


def smart_chunks(docs: DataFrame, ident: str = "doc_id", text: str = "text", tokens: int = 3000, overlap: int = 400, headers: int = 5) -> DataFrame:
    """(id, chunk_idx, chunk): sections packed greedily into chunks; without enough headers, plain windows.

    A token is four characters. Text before the first header is left out; a section above the limit
    is cut into windows.
    """
    small_batches(docs.sparkSession, ROWS_AT_ONCE, BYTES_AT_ONCE)
    size, step = tokens * 4, overlap * 4

    def pack(t: str) -> list[str]:
        starts = [m.start() for m in _HEADER.finditer(t)]
        plain = lambda x: [x[i : i + size] for i in window_starts(len(x), size, step)]
        if len(starts) <= headers:
            return plain(t)
        out, held = [], ""
        for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
            part = t[a:b]
            if len(part) // 4 > tokens:
                out += [held] * bool(held) + plain(part)
                held = ""
            elif len(held) // 4 + len(part) // 4 > tokens:
                out.append(held)
                held = part
            else:
                held += part
        return out + [held] * bool(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, c) for i, t in zip(pdf["id"], pdf["t"], strict=True) if t for k, c in enumerate(pack(t))]
            yield pd.DataFrame(rows, columns=[ident, "chunk_idx", "chunk"])

    return docs.select(F.col(ident).alias("id"), F.col(text).alias("t")).mapInPandas(run, f"`{ident}` long, chunk_idx int, chunk string")


def call_model(rows: DataFrame, prompt: str, reply: str, call: Callable[[str], str], policy: Policy = Policy()) -> DataFrame:
    """Rows plus the reply of an injected model to each prompt; null where it fails (see models.ask)."""
    return ask(rows, prompt, call, policy, reply).select(*rows.columns, reply)


def stub_model(prompt: str) -> str:
    """A deterministic stand-in for a model: a title from the prompt's first clause, in a fenced block."""
    import json

    lines = prompt.split("\n")
    return "```json\n" + json.dumps({"group_title": lines[1][:40] if len(lines) > 1 else "", "clauses": len(lines) - 1}) + "\n```"
