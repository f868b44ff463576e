"""Placement of documents on shards by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a prime-sized table. The shards take turns, each
claiming the first free slot of its order, until all slots are taken. A document's slot is its digest modulo the
prime, so that its shard is one lookup; the table's size is fixed, which bounds what is broadcast. When a shard
joins or leaves, few other slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(48))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot the position of its shard in `shards`."""
    if not _is_prime(slots) or len(shards) > slots:
        raise ValueError("slots must be a prime that is not below the number of shards")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names, each once")
    numbers = [int.from_bytes(hashlib.sha256(s.encode()).digest()[:16]) for s in shards]
    offset = [n % slots for n in numbers]
    skip = [n // slots % (slots - 1) + 1 for n in numbers]
    table, tried, taken = [-1] * slots, [0] * len(shards), 0
    while taken < slots:
        for k in range(len(shards)):
            # a prime size makes every skip visit all slots
            while table[slot := (offset[k] + tried[k] * skip[k]) % slots] >= 0:
                tried[k] += 1
            table[slot] = k
            taken += 1
            if taken == slots:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Sixty bits of the key's md5, modulo the size; a null key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots)


def shard(
    docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """doc_id, slot, shard for every row; a broadcast join with the table of `slots` rows and no shuffle.

    Equal keys share a shard, repeated rows stay, null keys go where empty text goes. Text and other columns are
    not read.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(slot, shards[k]) for slot, k in enumerate(lookup_table(shards, slots))], "slot long, shard string"
    )
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), slot_of(F.col(key), slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")
