"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a prime-sized table (offset + k * skip, all
slots exactly once). The shards take turns in claiming their next free preferred slot, weights giving more
turns. Placement is then one hash, one remainder and one lookup, and removing a shard moves few other slots.

Nulls: a null key is hashed like any other value and so has one fixed shard. Repeated keys share a shard, as do keys
whose hashes are tied by the remainder. Keys of any type that Spark hashes and of any length are hashed whole.
An empty table gives an empty result; other columns pass through, but those with the names of the two results are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table; prime. The broadcast table has this many rows whatever the input.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _preference(name: str, size: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "little") % size, int.from_bytes(digest[8:16], "little") % (size - 1) + 1


def build_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """table[slot] = index into shards. weights: turns of a shard in each round, 1 where not given."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if not _is_prime(size) or len(shards) > size:
        raise ValueError("the table size must be prime and no less than the number of shards")
    turns = [i for i, s in enumerate(shards) for _ in range((weights or {}).get(s, 1))]
    if not turns or any(w < 0 for w in (weights or {}).values()):
        raise ValueError("weights must not be negative or all zero")
    prefs = [_preference(s, size) for s in shards]
    step, table, free = [0] * len(shards), [-1] * size, size
    while free:
        for i in turns:
            offset, skip = prefs[i]
            while True:
                slot = (offset + step[i] * skip) % size
                step[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with slot_col and shard_col, which replace columns of these names. The lookup table has exactly `size` rows, so it is always broadcast."""
    if len({key, slot_col, shard_col}) < 3:
        raise ValueError("the key and the two results must have different names")
    table = build_table(shards, size, weights)
    lookup = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], "__slot int, __shard string")
    placed = df.withColumn("__at", slot_of(F.col(f"`{key}`"), size)).join(F.broadcast(lookup), F.col("__at") == F.col("__slot"), "left")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot_col, shard_col)]
    return placed.select(*kept, F.col("__at").alias(slot_col), F.col("__shard").alias(shard_col))
