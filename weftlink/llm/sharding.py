"""Sharding by a permutation-filled lookup table, with DataFrame expressions only.

Each shard has its own order of preference over the slots of a prime-sized table; shards take turns to claim their next
free slot until all are taken. A document's key is hashed to a slot, and the slot names the shard. The table has
`slots` entries, whatever the data's size, and is part of the plan as one array, so placement takes constant time and
no shuffle. Adding or removing a shard moves few slots.

Defined results: a null key is placed as the empty text; equal keys share a shard; text and other columns aren't read;
an empty table gives no rows. A hot source or group of copies spreads out, because the document id is the key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters: a prime of over a hundred times the shards keeps them within about one hundredth of each other.
SLOTS, SHARDS = 4093, 32


def _number(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Which shard (its place in the list) holds each slot; `slots` is a prime above the number of shards."""
    if not shards or slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime above the number of shards, of which there is at least one")
    start = [_number(f"{s}#start") % slots for s in shards]
    skip = [_number(f"{s}#skip") % (slots - 1) + 1 for s in shards]
    table, turn, claimed = [-1] * slots, [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while table[slot := (start[i] + turn[i] * skip[i]) % slots] >= 0:
                turn[i] += 1
            table[slot] = i
            claimed += 1
            if claimed == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """The rows with their slot and shard."""
    table = lookup_table([f"shard-{i}" for i in range(shards)], slots)
    out = df.withColumn(slot_name, slot_of(F.col(key), slots))
    return out.withColumn(shard_name, F.get(F.array(*map(F.lit, table)), F.col(slot_name).cast("int")))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> None:
    """Writes each shard to its own folder; rows spread over all tasks, so a shard's size bounds no task."""
    place(df, key, shards, slots).drop("slot").write.partitionBy("shard").parquet(path)
