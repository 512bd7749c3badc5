"""Sharding: a lookup table of prime size that shards fill in turns by preference order.

Each shard's preferences are a permutation of the table's slots, ``(offset + i * skip) mod size``
with offset and skip from the MD5 of the shard's name; as the size is prime, every skip is
coprime to it. Shards take turns, each claiming its first preferred slot that is still free, until
none is free. All shards own slots within one of each other, and adding or removing a shard moves
little beyond its own share of the keys.

The table has ``size`` rows whatever the data's size, so it is broadcast; a row is placed by one
hash and one lookup, without a shuffle. Placement is DataFrame code only.

Defined results: a null key counts as a key of its own (all null keys share a shard); repeated
rows and equal keys land together; an empty table gives an empty result; other columns are kept, but
for ones named ``slot`` or ``shard``, which the added columns replace; the key may be one of them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Production parameters: a prime over 100 times the shards keeps shares within 1 %.
SHARDS, SIZE = 32, 4099
#: The largest table that is broadcast; its rows take 12 bytes each.
MOST_SLOTS = 1_000_003


def _digits(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], size: int = SIZE) -> list[int]:
    """The shard (its index in ``names``) that owns each slot."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(size) or not len(names) <= size <= MOST_SLOTS:
        raise ValueError(f"size must be a prime from the number of shards to {MOST_SLOTS}")
    at = [_digits(f"offset|{name}") % size for name in names]
    skip = [_digits(f"skip|{name}") % (size - 1) + 1 for name in names]
    owner: list[int] = [-1] * size
    for turn in range(size):
        shard = turn % len(names)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + skip[shard]) % size
        owner[at[shard]] = shard
    return owner


def slot_of(key: Column, size: int = SIZE) -> Column:
    """A key's slot: 60 bits of the MD5 of its text, modulo the table's size."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: Column, names: list[str], size: int = SIZE) -> DataFrame:
    """``df`` with its ``slot`` and ``shard``."""
    listed = F.split(F.lit(",".join(map(str, lookup_table(names, size)))), ",")
    owners = df.sparkSession.range(1).select(F.posexplode(listed).alias("slot", "owner")).select("slot", F.col("owner").cast("int").alias("shard"))
    placed = df.withColumn("slot", slot_of(key, size)).drop("shard")
    return placed.join(F.broadcast(owners), "slot")  # size rows


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return place(docs, F.col("doc_id"), shard_names()).select("doc_id", "n_bytes", "slot", "shard")


#: The turns are replayed one by one, with the table as a list.
ORACLE = f"""
WITH RECURSIVE pref AS (
  SELECT i AS shard,
         ('0x' || substr(md5('offset|shard-' || i), 1, 15))::BIGINT % {SIZE} AS first_slot,
         ('0x' || substr(md5('skip|shard-' || i), 1, 15))::BIGINT % {SIZE - 1} + 1 AS skip
  FROM range({SHARDS}) t(i)
), turns AS (
  SELECT 0 AS turn, list_transform(range({SIZE}), lambda x: -1) AS owner, -1::BIGINT AS claimed
  UNION ALL
  SELECT turn + 1,
         list_transform(range({SIZE}), lambda x: CASE WHEN x = slot THEN (turn % {SHARDS})::INTEGER ELSE owner[x + 1] END),
         slot
  FROM (
    SELECT turn, owner, list_filter(list_transform(range({SIZE}), lambda n: (first_slot + n * skip) % {SIZE}), lambda s: owner[s + 1] < 0)[1] AS slot
    FROM turns JOIN pref ON shard = turn % {SHARDS}
    WHERE turn < {SIZE}
  )
), filled AS (
  SELECT owner FROM turns WHERE turn = {SIZE}
), slots AS (
  SELECT unnest(range({SIZE}))::INTEGER AS slot, unnest(owner)::INTEGER AS shard FROM filled
), docs AS (
  SELECT doc_id, strlen(text)::BIGINT AS n_bytes,
         (('0x' || substr(md5(coalesce('k' || doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {SIZE})::INTEGER AS slot
  FROM documents
)
SELECT doc_id, n_bytes, slot, shard FROM docs JOIN slots USING (slot)
"""
