"""Sharding by a lookup table that the shards fill in turns.

Every shard has a preference order over the slots of a prime-sized table: a start and a step, both hashed from its
name, walk through all slots. Shards take turns; at its turn each claims the first free slot of its order. So all get
nearly the same number of slots, and if a shard goes, few slots change hands among those that stay. A row's key is
hashed to a slot, and the table, whose size is fixed, is broadcast: placing a row takes constant time and no shuffle.

DataFrame functions only. Defined results: a null key has its own fixed slot; equal keys share a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; a prime, and so large that shares differ by less than a percent for hundreds of shards.
SLOTS = 65537
#: The most slots that are broadcast.
MOST_SLOTS = 1 << 20


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def filled(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the place of its shard in `shards`."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be named, each once, and no more than there are slots")
    if slots < 2 or slots > MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at most {MOST_SLOTS}")
    at = [_number(f"start {s}") % slots for s in shards]
    step = [_number(f"step {s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 48 bits of its MD5, which any engine can compute, modulo the table's size."""
    named = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("long") % F.lit(slots)).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): a literal that the executors unfold, of `slots` rows."""
    listed = F.lit(",".join(map(str, filled(shards, slots))))
    return spark.range(0, 1, 1, 1).select(F.posexplode(F.split(listed, ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def sharded(docs: DataFrame, shards: int | Sequence[str] = 64, slots: int = SLOTS, key_col: str = "doc_id") -> DataFrame:
    """The rows with their slot and shard added, in columns of these names that replace any the table had."""
    names = [f"shard-{k}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    rows = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{key_col}`"), slots))
    return rows.join(F.broadcast(lookup_table(docs.sparkSession, names, slots)), "slot").select(*(F.col(f"`{c}`") for c in rows.columns), "shard")
