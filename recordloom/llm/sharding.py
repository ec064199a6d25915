"""Consistent placement by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime size: it starts at
an offset and steps by a skip, both hashed from the shard's name, so the order is a permutation.
The shards take turns, each claiming the next free slot it prefers; a shard of weight w takes w
turns a round. A row finds its shard by hash and one lookup. When a shard leaves, nearly all
slots of the others stay as they were.

The table's size is a parameter, never a function of the data, so broadcasting it is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

SIZE = 16381
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
MOST_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """First slot and step of a shard's order over the slots."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1


def lookup_table(shards: Sequence[str] | Mapping[str, int] = SHARDS, size: int = SIZE) -> list[str]:
    """Slot -> shard. `shards` may map a name to a whole-numbered weight of turns."""
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1)
    if not weights or any(w < 1 for w in weights.values()):
        raise ValueError("at least one shard is needed, each with a weight of 1 or more")
    if not is_prime(size) or size > MOST_SLOTS or size < len(weights):
        raise ValueError(f"the table's size must be a prime from the number of shards to {MOST_SLOTS}")
    order = {name: preference(name, size) for name in weights}
    at = dict.fromkeys(weights, 0)
    table: list[str | None] = [None] * size
    left = size
    while left:
        for name, turns in weights.items():
            offset, skip = order[name]
            for _ in range(min(turns, left)):
                while table[slot := (offset + at[name] * skip) % size] is not None:
                    at[name] += 1
                table[slot] = name
                at[name] += 1
                left -= 1
    return table


def place(df: DataFrame, key: str, shards: Sequence[str] | Mapping[str, int] = SHARDS,
          size: int = SIZE) -> DataFrame:
    """Columns `key`, key_hash, slot, shard: one row per input row.

    The key is hashed as text; null is hashed as a text that no number can have ("null"), so
    it has a place too. Equal keys get equal places, repeated rows stay repeated, an empty
    table gives an empty one, and only the key column is read. A key column of the name of a result's
    column stands first and keeps its values, beside the result's column of that name.
    """
    names = lookup_table(shards, size)
    # a literal of bounded length, unfolded on the executors' side: no rows go through Python
    slots = (df.sparkSession.range(1)
             .select(F.posexplode(F.split(F.lit("\n".join(names)), "\n")).alias("slot", "shard")))
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 15), 16, 10)
    # the key travels in a struct, so it may have any name; the result then has two columns of it
    placed = (df.select(F.struct(F.col(key).alias("k")).alias("_key"), hashed.cast("long").alias("key_hash"))
              .withColumn("slot", F.expr(f"cast(key_hash % {size} as int)"))
              .join(F.broadcast(slots), "slot"))
    return placed.select(F.col("_key.k").alias(key), "key_hash", F.col("slot").cast("long").alias("slot"), "shard")


def moved(before: Sequence[str], after: Sequence[str]) -> float:
    """Share of slots whose shard differs between two tables of one size."""
    return sum(a != b for a, b in zip(before, after, strict=True)) / len(before)
