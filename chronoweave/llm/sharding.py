"""Placement of keys on shards by a permutation-filled lookup table.

Each shard has a preference order of the slots of a table of prime size: start + j*skip modulo the size, start and skip
from hashes of its name. The shards take turns, each claiming its next preferred slot that is free, until the table is
full. So all shards hold nearly equal shares, and when a shard comes or goes few slots move. The table depends on the
shards alone, has a fixed size and is broadcast: placing a row is one hash and one lookup, with no shuffle.

Nulls: a null key is the empty text. Equal keys share a shard. An empty table gives no rows; all columns stay, and new
ones that clash with them are an error."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the number of its shard."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the size of the table must be prime")
    if size < len(shards):
        raise ValueError("the table must have a slot for each shard at least")
    order = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        order.append([int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1])
    slots, free = [-1] * size, size
    while free:
        for shard, turn in enumerate(order):
            while slots[turn[0]] >= 0:
                turn[0] = (turn[0] + turn[1]) % size
            slots[turn[0]] = shard
            free -= 1
            if not free:
                break
    return slots


def slot_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard_no, shard), a row for each slot."""
    filled = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")).alias("slot", "shard_no"))
    names = F.split(F.lit("\n".join(shards)), "\n")
    return filled.select(F.col("slot").cast("long").alias("slot"), F.col("shard_no").cast("int").alias("shard_no")).withColumn("shard", F.get(names, F.col("shard_no")))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The first 60 bits of the key's MD5, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(size))


def place(df: DataFrame, key: str, shards: list[str], *, size: int = TABLE_SIZE) -> DataFrame:
    """df with the columns slot, shard_no and shard."""
    if clash := {"slot", "shard_no", "shard"} & set(df.columns):
        raise ValueError(f"df already has {sorted(clash)}")
    table = slot_table(df.sparkSession, shards, size)
    return df.withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(table), "slot").select(*df.columns, "slot", "shard_no", "shard")  # `size` rows


def moved_slots(before: list[str], after: list[str], size: int = TABLE_SIZE) -> int:
    """How many slots change their shard when the shards change."""
    return sum(before[a] != after[b] for a, b in zip(fill_table(before, size), fill_table(after, size)))
