"""Operator 8, byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

Token-position rows join the merge table; each round contracts every word's leftmost pair of
minimum rank until no word has a pair left. Decoding joins ids with the token table and aggregates
the bytes in order of position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructType

from clauseworks.llm._streams import small_batches
from clauseworks.llm.pretoken import ranks, splitter

#: Words of a generation that a Python worker remembers; it keeps the present generation and the one before. Bounds memory, not results.
REMEMBERED = 200_000
#: Longer words are cut where no token of the vocabulary can span; pieces that are longer still go through a query whose
#: rounds contract all occurrences of the least pair where that is the same (see Codec).
LONG = 48
#: Bytes of a piece that one query takes; longer pieces go through in windows.
WINDOW = 1 << 16

_SHORT = """
with recursive t(s, w, p, tok) as (
    select 0, w, p, tok from start
    union all
    select x.s + 1, x.w, case when x.p > b.h then x.p - 1 else x.p end, case when x.p = b.h then b.merged else x.tok end
    from t x
    join (
        select y.w, min((m.rank::bigint << 32) | y.p) & 4294967295 as h, min(m.rank) as merged
        from t y join t z on z.w = y.w and z.p = y.p + 1
        join merges m on m.a = y.tok and m.b = z.tok
        group by y.w
    ) b on b.w = x.w
    where x.p <> b.h + 1
)
select w, p, tok from t join (select w, max(s) as s from t group by w) f using (w, s) order by w, p
"""

_LONG = """
with recursive t(w, p, tok, alive) using key (w, p) as (
    select w, p, tok, true from start
    union all
    select w, p, case when chosen then merged else tok end, not coalesce(lag(chosen) over (partition by w order by p), false)
    from (
        select *, hit and case when together then (row_number() over (partition by w, hit, run order by p)) % 2 = 1 else p = h end as chosen
        from (
            select *, n - row_number() over (partition by w, hit order by p) as run, min(case when hit then p end) over (partition by w) as h
            from (
                select *, coalesce(rank = min(rank) over (partition by w), false) as hit, min(rank) over (partition by w) as least
                from (
                    select x.*, m.rank, m.merged, m.together
                    from (
                        select w, p, tok, lead(tok) over (partition by w order by p) as next, row_number() over (partition by w order by p) as n
                        from t where alive
                    ) x
                    left join merges m on m.a = x.tok and m.b = x.next
                )
            )
            where least is not null
        )
    )
)
select w, p, tok from t where alive order by w, p
"""

_DECODE = """
select i.w, string_agg(t.hexed, '' order by i.p) as hexed
from ids i join tokens t on t.id = i.tok group by i.w order by i.w
"""


class Codec:
    """A vocabulary in an in-memory DuckDB, and the words encoded so far."""

    def __init__(self, path: str):
        table = ranks(path)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        rows = [(table[t[:i]], table[t[i:]], r) for t, r in table.items() for i in range(1, len(t)) if t[:i] in table and t[i:] in table]
        # A merge of a and b can be made for all its occurrences at once unless a pair that ranks before it may come of it:
        # such a pair is the merged token with a token p before it, where p and a don't make an earlier pair themselves
        # (or they would have been merged by now), or with a token s after it, likewise.
        before, after = {}, {}
        for x, rank in table.items():
            for i in range(1, len(x)):
                if x[:i] in table and table.get(x[i:], -1) > rank:
                    before.setdefault(x[i:], []).append(x[:i])
                if x[i:] in table and table.get(x[:i], -1) > rank:
                    after.setdefault(x[:i], []).append(x[i:])
        token = {r: t for t, r in table.items()}
        together = []
        for a, b, r in rows:
            t, left, right = token[r], token[a], token[b]
            alone = any(table.get(p + left, r) >= r for p in before.get(t, ())) or any(table.get(right + s, r) >= r for s in after.get(t, ()))
            together.append(not alone)
        a, b, r = (np.array(x, np.int32) for x in zip(*rows, strict=True))
        merges = pa.table({"a": a, "b": b, "rank": r, "merged": r, "together": np.array(together)})
        tokens = pa.table({"id": pa.array(table.values(), pa.int32()), "hexed": pa.array([t.hex() for t in table])})
        for name, data in (("merges", merges), ("tokens", tokens)):
            self.db.register("given", data)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")
        self.path = path
        self.bytes_of = np.zeros(max(table.values()) + 1, np.int64)
        self.bytes_of[list(table.values())] = [len(t) for t in table]
        self.byte = np.array([table[bytes([b])] for b in range(256)], np.int32)
        #: word -> (ids as text, number of ids, decoded bytes); of this generation, and of the one before
        self.words: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def _query(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    @cached_property
    def tokens(self) -> set[bytes]:
        return set(ranks(self.path))

    @cached_property
    def starts(self) -> set[bytes]:
        """What tokens begin with, themselves included; needed only once a long word is met."""
        return {t[:i] for t in self.tokens for i in range(2, len(t) + 1)}

    def pieces(self, word: bytes) -> list[bytes]:
        """The word, cut between bytes that no token in it spans: those are never contracted with each other."""
        spanned = np.zeros(len(word) + 1, np.int32)
        for i in range(len(word) - 1):
            j = i + 2
            far = i + 1
            while j <= len(word) and word[i:j] in self.starts:
                far = j if word[i:j] in self.tokens else far
                j += 1
            spanned[i + 1] += 1
            spanned[far] -= 1
        cuts = [0, *(np.flatnonzero(spanned[1:-1].cumsum() == 0) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def _long(self, piece: bytes) -> np.ndarray:
        n = len(piece)
        start = pa.table({"w": np.zeros(n, np.int32), "p": np.arange(n, dtype=np.int32), "tok": self.byte[np.frombuffer(piece, np.uint8)]})
        return self._query(_LONG, "start", start)["tok"].to_numpy()

    def windows(self, piece: bytes) -> np.ndarray:
        """The ids of a piece of any length, WINDOW bytes at a time.

        Tokens are the encoding of their bytes if every two neighbours are that of theirs: a merge across
        a boundary depends on its two sides only. So the ids of two windows may be put together
        where the second begins with the token that follows there in the first: all neighbours then
        stand next to each other in a window. Where no such place is found, the window doubles.
        """
        out, at, size = [], 0, WINDOW
        tok = self._long(piece[:size])
        while at + size < len(piece):
            starts = np.cumsum(self.bytes_of[tok]) - self.bytes_of[tok]
            for i in range(int(np.searchsorted(starts, size * 3 // 4)), max(0, int(np.searchsorted(starts, size // 2)) - 1), -max(1, len(tok) // 64)):
                follows = self._long(piece[at + int(starts[i]) : at + int(starts[i]) + size]) if i < len(tok) else tok
                if 0 < i < len(tok) and follows[0] == tok[i]:
                    out.append(tok[:i])
                    at, tok = at + int(starts[i]), follows
                    break
            else:
                size *= 2
                tok = self._long(piece[at : at + size])
        return np.concatenate([*out, tok])

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token rows of the words: (index of the word, id), by word and position."""
        cut = [[w] if len(w) <= LONG else self.pieces(w) for w in words]
        pieces = [x for some in cut for x in some]
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), [len(some) for some in cut])
        parts = []
        lengths = np.array([len(x) for x in pieces], np.int64)
        for i in np.flatnonzero(lengths > WINDOW).tolist():
            tok = self.windows(pieces[i])
            parts.append((np.full(len(tok), i, np.int32), tok))
        for sql, chosen in ((_SHORT, lengths <= LONG), (_LONG, (lengths > LONG) & (lengths <= WINDOW))):
            index = np.flatnonzero(chosen)
            if not len(index):
                continue
            n = lengths[index]
            w = np.repeat(index, n).astype(np.int32)
            p = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            tok = self.byte[np.frombuffer(b"".join([pieces[i] for i in index.tolist()]), np.uint8)]
            got = self._query(sql, "start", pa.table({"w": w, "p": p, "tok": tok}))
            parts.append((got["w"].to_numpy(), got["tok"].to_numpy()))
        w, tok = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(w, kind="stable")
        return word_of[w[order]], tok[order]

    def decode(self, w: np.ndarray, tok: np.ndarray) -> list[bytes]:
        """The bytes of sequences of ids: rows of one w, in the given order, are one sequence."""
        p = np.arange(len(w), dtype=np.int64)
        got = self._query(_DECODE, "ids", pa.table({"w": w, "p": p, "tok": tok}))
        return [bytes.fromhex(x) for x in got["hexed"].to_pylist()]

    def learn(self, words: list[str], step: int = 20_000) -> None:
        """Encode the words that are not known yet, in slices of bounded size."""
        for i in range(0, len(words), step):
            some = words[i : i + step]
            w, tok = self.contract([x.encode("utf-8") for x in some])
            decoded = self.decode(w, tok)
            ends = np.cumsum(np.bincount(w, minlength=len(some))).tolist()
            ids = list(map(str, tok.tolist()))
            at = 0
            for x, end, raw in zip(some, ends, decoded, strict=True):
                self.words[x] = (" ".join(ids[at:end]), end - at, raw)
                at = end

    def encode(self, texts: list[str | None], find) -> Iterator[list[tuple[str, int, bytes]]]:
        """For each text, its words' entries in order."""
        split = [find(t) if t else [] for t in texts]
        fresh = {w for words in split for w in words}
        new = fresh.difference(self.words)
        if self.words and len(self.words) + len(new) > REMEMBERED:
            self.older, self.words, new = self.words, {}, fresh
        # words that were met in the generation before go on, those that weren't are forgotten with it
        again = new.intersection(self.older)
        self.words |= {w: self.older[w] for w in again}
        self.learn(sorted(new - again, key=len))  # words of like lengths take like numbers of rounds
        known = self.words
        for words in split:
            yield [known[w] for w in words]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each Python worker and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches cut so that the texts of each hold about `most` bytes, or one row."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column)).to_pylist()
        start = size = 0
        for i, t in enumerate(sizes):
            n = len(t) if t else 0
            if i > start and size + n > most:
                yield batch.slice(start, i - start), sizes[start:i]
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield batch.slice(start), sizes[start:]


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: bool = False, prefix: str = "") -> DataFrame:
    """docs' columns plus n_tokens, ids_sha256 and decoded_sha256 (and with ids=True, the ids themselves).

    Each match of pattern is encoded by itself, without special tokens; the ids are then decoded.
    A null or empty text has no ids: n_tokens 0 and both digests those of the empty string. Rows
    keep their multiplicity; columns of docs that clash with a new name (after prefix) are replaced,
    whatever their case. A word of any length is encoded whole.
    One narrow stage: no shuffle. Memory: one slice of texts and two generations of REMEMBERED words a worker.
    """
    small_batches(docs.sparkSession)
    names = [f"{prefix}n_tokens", f"{prefix}ids_sha256", f"{prefix}decoded_sha256"] + [f"{prefix}ids"] * ids
    kept = docs.drop(*names)
    schema = StructType(kept.schema.fields[:])
    for name, kind in zip(names, ("long", "string", "string", ArrayType(IntegerType())), strict=False):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        find = splitter(pattern).findall
        for batch, texts in _slices(batches, text):
            n, sha, back, lists = [], [], [], []
            for words in c.encode(texts, find):
                joined = " ".join([x[0] for x in words])
                n.append(sum([x[1] for x in words]))
                sha.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([x[2] for x in words])).hexdigest())
                if ids:
                    lists.append(list(map(int, joined.split())))
            made = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())] + ([pa.array(lists, pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows' columns plus out: the bytes (binary) of the array of ids; null and empty arrays give b''."""
    small_batches(rows.sparkSession)
    kept = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            lists = [x or [] for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            w = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
            decoded = [b""] * len(lists)
            if len(w):
                for i, raw in zip(np.unique(w).tolist(), c.decode(w, np.array([y for x in lists for y in x], np.int32)), strict=True):
                    decoded[i] = raw
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, StructType(kept.schema.fields[:]).add(out, "binary"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents under byte_bpe_50k.tiktoken."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
