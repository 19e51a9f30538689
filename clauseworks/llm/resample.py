"""Operator 13, target-distribution importance resampling: hashed n-gram weights, and an exact draw by radix selection.

1. Features (runs of words) of documents and of the target are counted by hashed bucket. What leaves
   a task is one row for each bucket that it met, so both tables of counts are bounded.
2. A bucket's gain is the log ratio of its smoothed shares; the gains are an array, and a document's
   weight is their sum over its features. Texts are scored as arrays of bytes, whole.
3. A score is the weight plus noise of the id. The key of the last row drawn is found digit by digit
   (score, then id, then row): each round counts the rows of each digit among those that share the
   digits found so far. Nothing is sorted for that.
4. Only the rows drawn are sorted by range and numbered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm._streams import bytes_of, small_batches
from clauseworks.operators.similarity import numbered
from clauseworks.runtime import materialize

#: Buckets of features, least words of a document that is drawn, and the noise's seed.
BUCKETS, LEAST_WORDS, SEED = 10_000, 20, 2024
#: Bytes of text that are worked on at once, and features above this length are hashed one by one.
PIECE, LONG = 1 << 19, 48
#: Bits of a digit of the radix selection.
DIGIT = 12


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
#: For each byte: itself, A-Z in lower case, and 0 where no word has it.
_WORD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each slice of an array of bytes."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long = int((size > LONG).sum())
    out = np.empty(len(size), np.uint32)
    for i in order[:long].tolist():
        out[i] = crc32(data[starts[i] : ends[i]].tobytes())
    order = order[long:]
    state, at, size = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order], size[order]
    left = np.searchsorted(-size, -np.arange(1, LONG + 1), side="right")  # slices of at least 1, 2, ... bytes
    for j, n in enumerate(left.tolist()):
        if not n:
            break
        some = state[:n]
        state[:n] = _CRC[(some ^ data[at[:n] + j]) & 0xFF] ^ (some >> np.uint32(8))
    out[order] = ~state
    return out


def _pieces(texts: list[memoryview]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, text of each byte): texts and parts of long ones, PIECE bytes and more at a time; no word is cut.

    Texts are kept apart by a byte that no word has.
    """
    held: list[np.ndarray] = []
    of: list[np.ndarray] = []
    size = 0
    for i, t in enumerate(texts):
        raw, at = np.frombuffer(t, np.uint8), 0
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            while end < len(raw) and _WORD[raw[end]]:  # to the end of the word
                gaps = np.flatnonzero(_WORD[raw[end : end + PIECE]] == 0)
                end = end + int(gaps[0]) if len(gaps) else min(end + PIECE, len(raw))
            held += [raw[at:end], np.zeros(1, np.uint8)]
            of.append(np.full(end - at + 1, i, np.int32))
            size += end - at
            at = end
            if size >= PIECE:
                yield np.concatenate(held), np.concatenate(of)
                held, of, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(of)


def features(texts: list[memoryview], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each feature, its crc32, text of each word) of a piece of texts at a time.

    Features are the runs of 1 to `longest` words of a text, joined by one space.
    """
    tail: tuple[int, np.ndarray, int] | None = None  # the last words of a text that goes on in the next piece
    for raw, of in _pieces(texts):
        carried = 0
        if longest > 1 and tail is not None and tail[0] == of[0]:
            raw, of = np.concatenate([tail[1], raw]), np.concatenate([np.full(len(tail[1]), tail[0], np.int32), of])
            carried = tail[2]
        data = _WORD[raw]
        word = data > 0
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            continue
        text = of[starts]
        own = np.arange(len(starts)) >= carried
        if longest == 1:
            yield text, hashes(data, starts, ends), text
            continue
        size = ends - starts
        at = np.cumsum(size + 1) - size - 1  # the words again, with one space after each
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        joined[np.arange(len(joined)) - np.repeat(at, size + 1) < np.repeat(size, size + 1)] = data[word]
        for n in range(1, min(longest, len(starts)) + 1):
            last = np.arange(n - 1, len(starts))
            good = (text[last - n + 1] == text[last]) & own[last]
            last = last[good]
            yield text[last], hashes(joined, at[last - n + 1], at[last] + size[last]), text[last] if n == 1 else text[:0]
        keep = np.flatnonzero(text == text[-1])[-(longest - 1) :]
        tail = (int(text[-1]), joined[at[keep[0]] :], len(keep))


def bucket_counts(rows: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; at most `buckets` rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, crc, _ in features(bytes_of(b.column(0)), longest):
                total += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = rows.select(F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the buckets' shares in the target and in the source, one feature added to each bucket; rounded down."""
    m = len(source)
    s_all, t_all = float(int(source.sum()) + m), float(int(target.sum()) + m)
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, ident: object) -> int:
    """Gumbel noise in thousandths, rounded down, that depends on the seed and the id only."""
    h = int(sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _digit(rows: DataFrame, key: str, rank: int, descending: bool) -> tuple[DataFrame, int]:
    """(rows with the key of the rank-th row in the order of key, its rank among those), key by digits of DIGIT bits.

    A round counts the rows of each value of a digit, of which there are at most 2 ** DIGIT.
    """
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    while lo < hi:
        shift = max(0, (hi - lo).bit_length() - DIGIT)
        wide = lambda x: F.lit(x).cast("decimal(20,0)")
        digit = F.floor((F.col(key).cast("decimal(20,0)") - wide(lo)) / wide(1 << shift)).cast("int") if hi - lo >= 1 << 63 else F.shiftright(F.col(key) - F.lit(lo), shift)
        counts = rows.where(F.col(key).between(lo, hi)).groupBy(digit.alias("digit")).count().collect()
        for r in sorted(counts, key=lambda r: r["digit"], reverse=descending):
            if rank <= r["count"]:
                lo, hi = lo + (r["digit"] << shift), min(hi, lo + ((r["digit"] + 1) << shift) - 1)
                break
            rank -= r["count"]
    return rows.where(F.col(key) == F.lit(lo)), rank


def _reaches(score: int, at: tuple[int, int] | None) -> Column:
    """Whether a row's key (score descending, k, row) is that of the last row drawn or comes before it; at is (k, row)."""
    if at is None:
        return F.col("score") >= score
    later = (F.col("k") < at[0]) | ((F.col("k") == at[0]) & (F.col("row") <= at[1]))
    return (F.col("score") > score) | ((F.col("score") == score) & later)


def resample(rows: DataFrame, target: DataFrame, ident: str = "doc_id", text: str = "text", share: tuple[int, int] = (10, 100), longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """A row for each row: ident, n_features, weight, score, rank (1, 2, 3... of the rows drawn, else null).

    rows are weighed by how much likelier their features are in the target (its column `text`) than in
    all rows. Of the rows with least_words words or more, floor(share * their number) of the highest
    scores are drawn: ties go to the smaller id (a missing one comes last), then to the row that comes
    first in the table as it is read here. Null and empty texts have no features, weight 0 and are not
    drawn. Rows that repeat an id are rows of their own with equal noise. Ids are integers. The weight
    of a document is that of its whole text. Other columns aren't read. An empty table, or an empty
    target, is counted as no features.
    """
    small_batches(rows.sparkSession)
    gain = gains(bucket_counts(rows, text, longest, buckets), bucket_counts(target, "text", longest, buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, weight, words = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for of, crc, word in features(bytes_of(b.column(1)), longest):
                n += np.bincount(of, minlength=b.num_rows)
                np.add.at(weight, of, gain[crc % buckets])
                words += np.bincount(word, minlength=b.num_rows)
            full = weight + np.array([noise(seed, i) for i in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(weight), pa.array(full), pa.array(words >= least_words)], names=["id", "n_features", "weight", "score", "drawable"])

    given = rows.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("t"))
    scored = given.mapInArrow(score, "id long, n_features long, weight long, score long, drawable boolean")
    scored = materialize(scored.withColumn("k", F.coalesce("id", F.lit((1 << 63) - 1))).withColumn("row", F.monotonically_increasing_id()), "scores")
    drawable = scored.where("drawable")
    left = share[0] * drawable.count() // share[1]
    if left:
        last, at = None, None
        tied, left = _digit(drawable, "score", left, True)
        last = tied.first()["score"]
        if left < tied.count():
            tied, left = _digit(tied, "k", left, False)
            k = tied.first()["k"]
            at = (k, _digit(tied, "row", left, False)[0].first()["row"])
        drawn = F.col("drawable") & _reaches(last, at)
    else:
        drawn = F.lit(False)
    ranked = numbered(scored.where(drawn).withColumn("by", -F.col("score")), ["by", "k", "row"], "rank")
    columns = [F.col("id").alias(ident), "n_features", "weight", "score"]
    rest = scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, (F.col("rank") + 1).cast("long").alias("rank")).unionByName(rest)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth of the documents that is drawn to look like the benchmark, and every document's score."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return resample(read("documents").select("doc_id", "text"), read("benchmark").select("text"))


def _words(table: str) -> str:
    return f"regexp_extract_all(translate({table}.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: crc32 of a word, byte by byte and bit by bit, once for each distinct word.
_BIT = "list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, xor(a, b))"
_CRC_SQL = f"xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda i: cast(('0x' || substr(hex(encode(word)), 2 * i + 1, 2)) as bigint)), lambda a, b: {_BIT}, cast(4294967295 as bigint)), 4294967295)"

OP13_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce({_words('documents')}, []) as l from documents),
w as (select r, word, count(*) as n from (select r, unnest(l) as word from d) x group by all),
t as (select word, count(*) as n from (select unnest({_words('benchmark')}) as word from benchmark) x group by all),
hashed as (select word, {_CRC_SQL} % {BUCKETS} as bucket from (select word from w union select word from t) x),
counted as (select bucket, coalesce(sum(s), 0) as s, coalesce(sum(t), 0) as t from hashed left join (select word, sum(n) as s from w group by word) a using (word) left join (select word, n as t from t) b using (word) group by bucket),
sums as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from counted),
gain as (select bucket, cast(floor(1000 * ln(cast(t + 1 as double) * cast(s_all + {BUCKETS} as double) / (cast(s + 1 as double) * cast(t_all + {BUCKETS} as double)))) as bigint) as g from counted, sums),
weights as (select r, cast(sum(n * g) as bigint) as weight from w join hashed using (word) join gain using (bucket) group by r),
scored as (
  select r, doc_id, cast(len(l) as bigint) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double))) as bigint) as score
  from d left join weights using (r)
), ranked as (select *, n_features >= {LEAST_WORDS} as drawable, row_number() over (partition by n_features >= {LEAST_WORDS} order by score desc, doc_id nulls last, r) as place, count(*) over (partition by n_features >= {LEAST_WORDS}) as n from scored)
select doc_id, n_features, weight, score, cast(case when drawable and place <= 10 * n // 100 then place end as bigint) as rank from ranked
"""
