"""Operator 9, sharding: a permutation-filled lookup table, and placement by a broadcast of it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shards of the query, and the prime size of its table (over 100 slots a shard keep the shares within about 1 %).
SHARDS, SLOTS = 64, 6553


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(shards: list[str], slots: int) -> list[int]:
    """slot -> index of its shard.

    Each shard prefers the slots in the order (offset + j * skip) mod slots, a permutation since
    slots is prime. Shards take turns: each claims the first slot of its order that is free. Work
    and memory depend on the number of slots only, never on the data.
    """
    if not shards or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table needs shards and a prime size that is no less than their number")
    offset = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    table, at, free = [-1] * slots, offset[:], slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: its md5's first 32 bits mod the table's size (of a null key: that of the empty string)."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(rows: DataFrame, key: str | Column, shards: list[str], slots: int = 65537) -> DataFrame:
    """rows' columns plus slot (int), shard (string).

    The table has `slots` rows whatever the data, so it is broadcast: a row's place is one hash and
    one probe, without a shuffle, and rows keep their partitions. Equal keys go together; a null
    key is placed as the empty string. Adding or losing a shard moves few other keys. Columns of
    rows named slot or shard are replaced; an empty table gives an empty result.
    """
    names = ",".join(shards[i] for i in fill(shards, slots))
    table = rows.sparkSession.range(1).select(F.posexplode(F.split(F.lit(names), ",")).alias("slot", "shard"))
    key = F.col(key) if isinstance(key, str) else key
    kept = rows.withColumn("slot", slot_of(key, slots)).drop("shard")
    return kept.join(F.broadcast(table), "slot").select(*[c for c in rows.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(rows: DataFrame, key: str, shards: list[str], path: str, slots: int = 65537, rows_per_file: int = 1_000_000) -> None:
    """Write a folder for each shard. Rows are dealt by shard and a salt, so one large shard is many tasks."""
    placed = assign_shards(rows, key, shards, slots)
    placed.repartition("shard", F.pmod(F.xxhash64(key), F.lit(16))).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document by its id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return assign_shards(docs, "doc_id", [f"shard-{i:03d}" for i in range(SHARDS)], SLOTS).select("doc_id", "slot", "shard", "n_chars")


#: The table is filled in a recursive query of its own: at step k, shard k mod SHARDS claims the first free slot of its order.
OP9_SQL = f"""
with recursive shards as (
  select i, ('0x' || substr(md5('shard-' || lpad(cast(i as varchar), 3, '0') || '/offset'), 1, 8))::bigint % {SLOTS} as o,
         ('0x' || substr(md5('shard-' || lpad(cast(i as varchar), 3, '0') || '/skip'), 1, 8))::bigint % {SLOTS - 1} + 1 as skip
  from range({SHARDS}) r(i)
), prefs as (
  select list(list_transform(range({SLOTS}), lambda j: (o + j * skip) % {SLOTS}) order by i) as p from shards
), fill(k, slot, taken) as (
  select 0, p[1][1], bitstring(rpad('', {SLOTS}, '0'), {SLOTS}) from prefs
  union all
  select k, slot, taken from (
    select f.k + 1 as k, set_bit(f.taken, f.slot::int, 1) as taken,
           list_filter(p[(f.k + 1) % {SHARDS} + 1], lambda x: get_bit(set_bit(f.taken, f.slot::int, 1), x::int) = 0)[1] as slot
    from fill f, prefs where f.k + 1 < {SLOTS})
)
select doc_id, cast(slot as int) as slot, 'shard-' || lpad(cast(k % {SHARDS} as varchar), 3, '0') as shard, n_chars
from documents join (select k, slot from fill) t
  on t.slot = ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint % {SLOTS}
"""
