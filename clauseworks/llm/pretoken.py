"""Splitting of text before byte-pair merges, and vocabulary files."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import regex

#: The byte alphabet of byte-level BPE files: printable bytes stand for themselves, the rest follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


@lru_cache(4)
def splitter(pattern: str) -> regex.Pattern:
    r"""The pattern, compiled so that \s is Unicode White_Space (Python's own adds U+001C to U+001F)."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))


def as_bytes(token: str) -> bytes:
    return bytes(BYTE_OF[c] for c in token)


@lru_cache(2)
def merges(path: str) -> tuple[dict[int, tuple[int, int]], tuple[str, ...]]:
    """Of a tokenizers .json: (left << 20 | right) -> (rank, merged), over symbol numbers; special strings.

    Symbols 0 to 255 are the bytes.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    number = {bytes([b]): b for b in range(256)}
    pairs = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
        merged = number.setdefault(left + right, len(number))
        pairs[number[left] << 20 | number[right]] = (rank, merged)
    return pairs, tuple(t["content"] for t in spec.get("added_tokens", []))


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """Of a tiktoken rank file: token bytes -> rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
