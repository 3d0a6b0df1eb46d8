"""Shard placement by a permutation-filled lookup table.

Each shard has its own order of the slots of a table of prime size: offset, offset + skip, ..., from
two hashes of its name. Shards take turns, each claiming the first slot in its order that is still
free, until all slots are taken; so shards own equal numbers of slots but one, and taking one shard
out moves few others. A key's slot is its hash modulo the size. The table has a fixed size, is
broadcast, and a key's shard is one hash lookup. Only DataFrame functions run on the executors.

Keys are hashed as text by MD5, so that any engine gets the same slot; a null key counts as the empty
text. Equal keys get equal shards. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SIZE = 32, 4099


def number(text: str) -> int:
    """The first 60 bits of the MD5 of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(names: list[str], size: int) -> list[int]:
    """The shard of every slot."""
    if len(set(names)) != len(names) or not names:
        raise ValueError("shards need distinct names, one at least")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    offset = [number(f"{x}/offset") % size for x in names]
    skip = [number(f"{x}/skip") % (size - 1) + 1 for x in names]
    table, step, taken = [-1] * size, [0] * len(names), 0
    while True:
        for i in range(len(names)):
            while table[slot := (offset[i] + step[i] * skip[i]) % size] >= 0:
                step[i] += 1
            table[slot] = i
            taken += 1
            if taken == size:
                return table


def lookup(spark: SparkSession, names: list[str], size: int) -> DataFrame:
    """(slot, shard), made from one literal."""
    shards = F.split(F.lit(",".join(map(str, fill(names, size)))), ",")
    return spark.range(1).select(F.posexplode(shards).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str = "doc_id", names: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """(key, slot, shard) for every row."""
    names = names or [f"shard-{i}" for i in range(SHARDS)]
    table = F.broadcast(lookup(df.sparkSession, names, size))
    return df.select(F.col(key), slot_of(F.col(key), size).alias("slot")).join(table, "slot").select(key, "slot", "shard")


def place_sql(table: str, key: str, shards: int = SHARDS, size: int = SIZE) -> str:
    """DuckDB SQL for place(): the turns are played by a recursive query."""
    h = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE s AS (
  SELECT i, {h("'shard-' || i || '/offset'")} % {size} AS o, {h("'shard-' || i || '/skip'")} % {size - 1} + 1 AS k FROM range({shards}) t(i)),
prefs AS (SELECT list(o ORDER BY i) AS os, list(k ORDER BY i) AS ks FROM s),
turns AS (
  SELECT 0 AS turn, list_transform(range({size}), lambda x: -1) AS owner, list_transform(range({shards}), lambda x: 0::BIGINT) AS step
  UNION ALL
  SELECT turn + 1,
    list_transform(owner, lambda x, j: CASE WHEN j - 1 = (os[g] + f * ks[g]) % {size} THEN g - 1 ELSE x END),
    list_transform(step, lambda x, j: CASE WHEN j = g THEN f + 1 ELSE x END)
  FROM (SELECT *, list_filter(range(step[g], {size}), lambda x: owner[(os[g] + x * ks[g]) % {size} + 1] < 0)[1] AS f
        FROM (SELECT *, turn % {shards} + 1 AS g FROM turns, prefs WHERE turn < {size}))),
slots AS (SELECT unnest(range({size})) AS slot, unnest(owner) AS shard FROM turns WHERE turn = {size}),
keys AS (SELECT {key}, ({h(f"coalesce({key}::VARCHAR, '')")} % {size})::INT AS slot FROM {table})
SELECT {key}, keys.slot, slots.shard::INT AS shard FROM keys JOIN slots ON keys.slot = slots.slot"""
