"""Core-and-delta groups: topics, hybrid similarity, greedy splits."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.operators.staging import first_fit
from clauseworks.runtime import materialize

# Topics in order of precedence, families of standards
TOPICS = {
    "assembly": ["assembly", "assemble", "installation", "mounting", "unassembled"],
    "battery_charging": ["battery", "charging", "charger", "temperature range", "charge"],
    "maintenance": ["maintenance", "lubrication", "adjustment", "inspection", "repair"],
    "safety_warnings": ["warning", "danger", "caution", "risk", "hazard"],
    "manual_provision": ["instruction manual", "documentation", "instructions", "provided with"],
    "language": ["language", "translation", "official language"],
    "digital_format": ["digital", "electronic", "online", "downloadable", "paper format"],
    "composite": ["composite", "carbon", "wear", "damage", "rim"],
    "tampering": ["tampering", "modification", "alter", "modify"],
    "brakes": ["brake", "braking", "friction", "lever"],
    "electrical": ["electrical", "wiring", "cable", "connection"],
    "grounding": ["ground", "grounding", "earth"],
    "symbols": ["symbol", "marking", "label", "pictogram"],
    "tools": ["tool", "equipment", "necessary"],
}
FAMILIES = {"bicycle": ["16 CFR", "EN 15194", "ISO 4210"], "electrical": ["UL 2849", "47 CFR", "FCC"], "machinery": ["MD", "MR"]}
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "be", "is", "are", "was", "were"]
CONCEPTS = {"assembly": "assembly instructions", "maintenance": "maintenance procedures", "battery": "battery specifications", "warning": "safety warnings"}
MOST_MEMBERS, LEAST_SIMILARITY, LEAST_CORE_RATIO = 12, 0.70, 0.30


@lru_cache(maxsize=20_000)
def sorted_words(text: str) -> str:
    """Lower-cased words of letters and digits in order of the alphabet."""
    return " ".join(sorted("".join(c if c.isalnum() else " " for c in text.lower()).split()))


@lru_cache(maxsize=4096)
def letter_rows(text: str) -> dict[str, int]:
    """For each letter, the bits of its positions."""
    places: dict[str, int] = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    return places


def common_letters(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence, by rows of bits of a; 0 where it is found to be below `least` on the way."""
    places = letter_rows(a)
    full = (1 << len(a)) - 1
    row = full
    for at in range(0, len(b), 64):
        for c in b[at : at + 64]:
            if hit := row & places.get(c, 0):
                row = ((row + hit) | (row - hit)) & full
        if len(a) - row.bit_count() + max(0, len(b) - at - 64) < least:
            return 0
    return len(a) - row.bit_count()


class Packed:
    """Texts side by side in one number, each at a byte of its own with a bit between, so one pass of common_letters takes all of them."""

    def __init__(self, texts: list[str]) -> None:
        self.lengths = [len(t) for t in texts]
        self.places: dict[str, int] = {}
        self.starts, self.full, at = [], 0, 0
        for t in texts:
            self.starts.append(at // 8)
            for c, row in letter_rows(t).items():
                self.places[c] = self.places.get(c, 0) | row << at
            self.full |= ((1 << len(t)) - 1) << at
            at += (len(t) // 8 + 1) * 8
        self.starts.append(at // 8)

    def common_letters(self, b: str) -> list[int]:
        row = full = self.full
        places = self.places
        for c in b:
            if hit := row & places.get(c, 0):
                row = ((row + hit) | (row - hit)) & full
        left = row.to_bytes(self.starts[-1], "little")
        return [n - int.from_bytes(left[i:j], "little").bit_count() for n, i, j in zip(self.lengths, self.starts[:-1], self.starts[1:], strict=True)]


@lru_cache(maxsize=20_000)
def families(standard: str) -> frozenset[str]:
    return frozenset(f for f, names in FAMILIES.items() if any(k in standard for k in names))


def _extra(a: dict, b: dict) -> float:
    """What family, technical properties and warnings add to a similarity."""
    extra = 0.1 * (not families(a["standard"]).isdisjoint(families(b["standard"])))
    extra += 0.1 * ((a["temperature"], a["measurement"]) == (b["temperature"], b["measurement"]))
    return extra + 0.1 * (a["warning"] == b["warning"])


def hybrid_similarity(a: dict, b: dict, least: float = 0.0) -> float:
    """Agreement of sorted words, a tenth each for family, technical properties and warnings, at most 1.

    Less than `least`, but not by how much, where it is found to be below that before all is compared.
    """
    x, y = sorted_words(a["text"]), sorted_words(b["text"])
    extra = _extra(a, b)
    need = (least - extra - 1e-9) * (len(x) + len(y)) / 2
    if min(len(x), len(y)) < need:
        return 0.0
    score = 2 * common_letters(x, y, math.floor(need)) / (len(x) + len(y)) if x or y else 1.0
    return min(score + extra, 1.0)


def fitting(seeds: list[dict], step: int = 64) -> Callable[[dict], Iterator[int]]:
    """For a row, the places of the seeds with a similarity of LEAST_SIMILARITY or more, in order; seeds are compared `step` at a time."""
    slabs = [(i, seeds[i : i + step], Packed([sorted_words(x["text"]) for x in seeds[i : i + step]])) for i in range(0, len(seeds), step)]

    def found(row: dict) -> Iterator[int]:
        y = sorted_words(row["text"])
        for first, some, packed in slabs:
            for i, (seed, n, common) in enumerate(zip(some, packed.lengths, packed.common_letters(y), strict=True), first):
                score = 2 * common / (n + len(y)) if n or y else 1.0
                if min(score + _extra(seed, row), 1.0) >= LEAST_SIMILARITY:
                    yield i

    return found


def split_topics(rows: DataFrame) -> DataFrame:
    """(scope, topic, id, seed): greedy groups of at most MOST_MEMBERS around the first row that is still free.

    rows: scope, topic, id, text, standard, temperature, measurement, warning. A seed takes later free
    rows of its topic that are similar enough; rows that stay alone are left out. A scope holds the
    tables that are consolidated together; it may be one value for all rows.
    """

    def fits(seed: dict, row: dict) -> bool:
        return hybrid_similarity(seed, row, LEAST_SIMILARITY) >= LEAST_SIMILARITY

    made = first_fit(rows, ["scope", "topic"], fits, MOST_MEMBERS, ["text", "standard", "temperature", "measurement", "warning"], fitting)
    made = materialize(made, "splits")
    return made.join(made.where("id <> seed").select("seed").distinct(), "seed", "left_semi").select("scope", "topic", "id", "seed")


def seed_similarities(splits: DataFrame, rows: DataFrame) -> DataFrame:
    """(seed, id, similarity): the hybrid similarity of each member of a split with its seed."""
    columns = ["text", "standard", "temperature", "measurement", "warning"]
    seeds = rows.select(F.col("id").alias("seed"), *(F.col(c).alias(f"seed_{c}") for c in columns))
    pairs = splits.where("id <> seed").select("seed", "id").join(rows.select("id", *columns), "id").join(seeds, "seed")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [hybrid_similarity({c: x[f"seed_{c}"] for c in columns}, {c: x[c] for c in columns}) for x in pdf.to_dict("records")]
            yield pdf[["seed", "id"]].assign(similarity=made)

    return pairs.mapInPandas(score, "seed long, id long, similarity double")


def core_statement(texts: list[str]) -> tuple[str, list[str]]:
    """The statement of a group, and the words that all members have; empty if those are fewer than two."""
    lower = [t.lower() for t in texts]
    common = set.intersection(*(set(t.split()) for t in lower)) - set(STOP_WORDS)
    if len(common) < 2:
        return "", []
    core = "Instructions shall " if all("shall" in t for t in lower) else "The manufacturer shall provide "
    core += "".join(f"{x} " for k, x in CONCEPTS.items() if k in common)
    core += "including necessary details for safe use" if all("include" in t for t in lower) else ""
    return core.strip() + ".", sorted(common)


def deltas(member: dict, core: str) -> list[str]:
    """What a member has of its own: temperatures, units of measurement, formats, the word of warning."""
    text = member["text"]
    found = [f"Temperature: {', '.join(x)}" for x in [re.findall(r"[-\d]+\s*°[CF]", text)] if member["temperature"] and x]
    found += [f"Measurements: {', '.join(x)}" for x in [re.findall(r'\d+\.?\d*\s*(mm|cm|m|inch|")', text)] if member["measurement"] and x]
    found += [note for word, note in (("paper", "Paper format required"), ("digital", "Digital format allowed")) if word in text.lower() and word not in core.lower()]
    found += [f"Uses {w}" for w in ("WARNING", "CAUTION", "DANGER") if member["warning"] and w in text.upper()][:1]
    return found


def core_groups(members: DataFrame) -> DataFrame:
    """(topic, seed, size, core, least_ratio, similarity, deltas, accepted) of splits; those that pass three gates are accepted.

    members: seed, topic, id, text, standard, clause, temperature, measurement, warning. A20: all members
    have two words or more in common. A21: the statement's words make up LEAST_CORE_RATIO of each
    member's. A22: the mean similarity of all pairs is LEAST_SIMILARITY or more. A split has at most
    MOST_MEMBERS members, so its pairs are few.
    """

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("id").to_dict("records")
        core, _ = core_statement([x["text"] for x in rows])
        own = set(core.lower().split())
        words = [set(x["text"].lower().split()) for x in rows]
        ratios = [len(own & w) / len(w) for w in words if w]
        pairs = [hybrid_similarity(a, b) for a, b in combinations(rows, 2)]
        mean = sum(pairs) / len(pairs) if pairs else 0.0
        accepted = bool(core) and all(x >= LEAST_CORE_RATIO for x in ratios) and mean >= LEAST_SIMILARITY
        notes = "\n".join(f"{x['standard']} {x['clause']}: {'; '.join(d)}" for x in rows if (d := deltas(x, core)))
        made = (rows[0]["topic"], key[0], len(rows), core, min(ratios, default=1.0), mean, notes, accepted)
        return pd.DataFrame([made], columns=["topic", "seed", "size", "core", "least_ratio", "similarity", "deltas", "accepted"])

    return members.groupBy("seed").applyInPandas(build, "topic string, seed long, size int, core string, least_ratio double, similarity double, deltas string, accepted boolean")


def with_properties(clauses: DataFrame) -> DataFrame:
    """Temperature, measurement and warning of clauses (id, text, ...)."""
    t = F.col("text")
    return clauses.withColumns({"temperature": t.rlike("(?i)°C|temperature"), "measurement": t.rlike(r"(?i)\d+\s*(mm|cm|kg|V|A)\b"), "warning": t.rlike("(?i)warning|danger|caution")})
