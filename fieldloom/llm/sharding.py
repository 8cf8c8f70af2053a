"""Placement of documents on shards by a permutation-filled lookup table, in DataFrame functions.

Every shard has its own order of preference over the slots of a prime-sized table, ``(offset +
k * skip) mod slots`` with both numbers from a digest of its name.  Shards take turns claiming
their next free slot until the table is full, so shares differ by one slot at most, and leaving
or adding a shard moves few other slots.  The table has ``slots`` rows, a parameter and not a
property of the data; it is broadcast and every document finds its shard by one lookup.

A document's slot is a digest of its id, so equal ids share a shard and order does not matter.
Null ids hash as the empty text.  At least one shard name is needed and names are distinct;
``slots`` is prime and at least the number of shards.  An empty table gives an empty result.
Input columns are kept; ``slot`` and ``shard`` of the input, if any, are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = [f"shard-{k:02d}" for k in range(32)]
SLOTS = 3203


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[str]:
    """Shard name of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("distinct shard names are needed")
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime of at least the number of shards")
    start = [_digest(f"offset:{s}") % slots for s in shards]
    skip = [_digest(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    turn, table, left = [0] * len(shards), [""] * slots, slots
    while True:
        for k, name in enumerate(shards):
            at = (start[k] + turn[k] * skip[k]) % slots
            while table[at]:
                turn[k] += 1
                at = (start[k] + turn[k] * skip[k]) % slots
            table[at] = name
            left -= 1
            if not left:
                return table


def slot_of(id_col: str, slots: int) -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    names = F.split(F.lit(",".join(str(shards.index(s)) for s in lookup_table(shards, slots))), ",")
    known = F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(names).alias("slot", "k"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.get(known, F.col("k").cast("int")).alias("shard"))


def place(docs: DataFrame, shards: list[str] = SHARDS, slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``slot`` and ``shard``."""
    table = F.broadcast(table_frame(docs.sparkSession, shards, slots))
    return docs.drop("slot", "shard").withColumn("slot", slot_of(id_col, slots)).join(table, "slot").select(
        *(c for c in docs.columns if c not in ("slot", "shard")), "slot", "shard")


def placement_sql(shards: list[str] = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB statement for ``place`` over ``documents``: the turns are taken by recursion."""
    names = ", ".join(f"'{s}'" for s in shards)
    digest = "('0x' || substr(md5({} || n), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE shards AS (
  SELECT list(n ORDER BY k) names,
         list({digest.format("'offset:'")} % {slots} ORDER BY k) start,
         list({digest.format("'skip:'")} % {slots - 1} + 1 ORDER BY k) skip
  FROM (SELECT unnest([{names}]) n, generate_subscripts([{names}], 1) k)),
fill(step, slot, taken) AS (
  SELECT 0, start[1], [start[1]] FROM shards
  UNION ALL
  SELECT step + 1, pick, list_append(taken, pick) FROM (
    SELECT step, taken, list_filter(
      list_transform(range({slots}), lambda k: (start[(step + 1) % {len(shards)} + 1] + k * skip[(step + 1) % {len(shards)} + 1]) % {slots}),
      lambda s: NOT list_contains(taken, s))[1] pick
    FROM fill, shards WHERE step + 1 < {slots}))
SELECT doc_id, d.slot, names[step % {len(shards)} + 1] AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots} slot FROM documents) d
JOIN fill ON fill.slot = d.slot, shards"""
