"""Sharding through a lookup table that the shards fill in turns."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537  # a prime, over a hundred times the number of shards


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}|{name}".encode(), digest_size=8).digest(), "big")


@functools.lru_cache(maxsize=16)
def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """The number of the shard that owns each slot.

    Every shard prefers the slots in an order of its own, offset + i * step over a prime number
    of slots, which meets each slot once. The shards take turns, each claiming the first slot of its order that is still free.
    Shares differ by one slot at most; adding or removing a shard moves few other slots.
    """
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= slots:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    # by name, so that the order of the arguments does not matter
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while True:
        for s in order:
            while owner[at[s]] >= 0:
                at[s] = (at[s] + step[s]) % slots
            owner[at[s]] = s
            left -= 1
            if not left:
                return tuple(owner)


def shard_names(n: int) -> tuple[str, ...]:
    return tuple(f"shard-{i:05d}" for i in range(n))


def assign_shards(docs: DataFrame, shards: tuple[str, ...], doc_id: str = "doc_id", slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """All rows and columns, with the slot of the id and the name of the shard that owns it.

    The table has ``slots`` rows whatever the input, so it is broadcast and a row never leaves its task.
    The hash takes the id as text; null ids are one slot of their own. Rows with equal ids share a shard. Columns named like
    the two new ones are replaced.
    """
    owner = lookup_table(shards, slots)
    table = docs.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)], "_slot int, _shard string")
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (slot.lower(), shard.lower())]
    at = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(slots)).cast("int")
    placed = docs.select(F.struct(*keep).alias("_row"), at.alias("_at")).join(F.broadcast(table), F.col("_at") == F.col("_slot"))
    return placed.select("_row.*", F.col("_at").alias(slot), F.col("_shard").alias(shard))


def write_shards(placed: DataFrame, path: str, shard: str = "shard", files_per_shard: int = 8, doc_id: str = "doc_id") -> None:
    """One folder per shard; rows are dealt by shard and a salt, so a shard is several tasks' work."""
    salt = F.pmod(F.xxhash64(F.lit("file"), F.col(doc_id)), F.lit(files_per_shard))
    placed.repartition(F.col(shard), salt).write.partitionBy(shard).parquet(path)
