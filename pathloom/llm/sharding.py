"""Sharding by a permutation-filled lookup table; DataFrame functions only on the documents.

Each shard has a preference order of all slots of a table of prime size: slots from a hashed offset by a hashed
stride. Shards take turns, each claiming the first slot it prefers that is free, until none is. A key's hash picks
a slot, so a placement is one lookup, shards' shares differ by a slot at most, and few keys move as shards change.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

SHARDS, SLOTS = 16, 1613
#: Most slots of a table: it is a literal of the plan and broadcast.
MOST_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(shard: int, slots: int) -> tuple[int, int]:
    """Offset and stride of a shard's preference order."""
    return _number(f"offset:{shard}") % slots, _number(f"stride:{shard}") % (slots - 1) + 1


def lookup_table(shards: int, slots: int) -> list[int]:
    """The shard of each slot. ``slots`` must be prime, or strides would not reach every slot."""
    if not 1 <= shards <= slots <= MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError("the number of slots must be a prime, at least that of the shards and at most MOST_SLOTS")
    table = [-1] * slots
    orders = [preference(s, slots) for s in range(shards)]
    at, left = [0] * shards, slots
    while left:
        for shard, (offset, stride) in enumerate(orders):
            if not left:
                break
            while table[slot := (offset + at[shard] * stride) % slots] >= 0:
                at[shard] += 1
            table[slot] = shard
            left -= 1
    return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: its text's MD5, first 60 bits, modulo the slots; a null key is placed as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % slots


def shard(docs: DataFrame, *, key_col: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, out: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """``docs`` with the slot and the shard of each row's key; columns of these names are replaced.

    Rows of one key, repeated ones too, are in one shard; null keys have a place as any other. No row moves: the
    table, of ``slots`` rows, is broadcast.
    """
    spark = docs.sparkSession
    taken = {x.lower() for x in out if x.lower() != key_col.lower()}
    docs = docs.select(*[x for x in docs.columns if x.lower() not in taken])
    slot, found = c.fresh(docs, "slot_", "shard_")
    cells = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    table = spark.range(1).select(F.posexplode(cells).alias(slot, found)).select(F.col(slot).cast("bigint"), F.col(found).cast("bigint"))
    placed = docs.withColumn(slot, slot_of(F.col(key_col), slots)).join(F.broadcast(table), slot)
    return placed.select(*docs.columns, F.col(slot).alias(out[0]), F.col(found).alias(out[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the slot and the shard of every document."""
    return shard(c.table(spark, sf_dir, "documents").select("doc_id"))


def sql(documents: str = "documents", columns: str = "doc_id, slot, shard") -> str:
    """The same in DuckDB's SQL; the table is filled by a recursive query, a claim a step."""
    return f"""WITH RECURSIVE sh AS (SELECT i AS shard_no, ('0x' || substr(md5('offset:' || i), 1, 15))::BIGINT % {SLOTS} AS off, ('0x' || substr(md5('stride:' || i), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS stride FROM range({SHARDS}) t(i)),
prefs AS (SELECT list(off ORDER BY shard_no) AS offs, list(stride ORDER BY shard_no) AS strides FROM sh),
turns(n, claimed) AS (SELECT 0, []::BIGINT[] UNION ALL
  SELECT n + 1, list_append(claimed, list_filter(list_transform(range({SLOTS}), lambda j: (offs[n % {SHARDS} + 1] + j * strides[n % {SHARDS} + 1]) % {SLOTS}), lambda s: NOT list_contains(claimed, s))[1])
  FROM turns, prefs WHERE n < {SLOTS}),
cells AS (SELECT unnest(claimed) AS slot, (generate_subscripts(claimed, 1) - 1) % {SHARDS} AS shard FROM turns WHERE n = {SLOTS}),
keyed AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM {documents})
SELECT {columns} FROM (SELECT keyed.*, cells.shard::BIGINT AS shard FROM keyed JOIN cells USING (slot))"""
