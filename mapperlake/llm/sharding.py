"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table (an offset and a step of its own);
shards take turns, a shard of weight w taking w turns a round, and claim their next free slot until the table
is full. A key's slot is its hash modulo the table size, so placement is one lookup, and when a shard leaves
few keys of the others move. The table has at least SLOTS_PER_SHARD slots a shard and is the only thing
broadcast: its size depends on the number of shards, never on the data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS_PER_SHARD = 100


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def number(text: str) -> int:
    """The first 60 bits of a text's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], weights: list[int] | None = None, size: int | None = None) -> list[int]:
    """The shard index in every slot. Names must be distinct, weights at least 1."""
    weights = weights or [1] * len(shards)
    if not shards or len(set(shards)) < len(shards) or min(weights) < 1:
        raise ValueError("shards must be distinct names with weights of at least 1")
    size = size or next_prime(SLOTS_PER_SHARD * sum(weights))
    preference = [(number(f"offset:{s}") % size, number(f"skip:{s}") % (size - 1) + 1, 0) for s in shards]
    table, free = [-1] * size, size
    while free:
        for k, (offset, skip, at) in enumerate(preference):
            for _ in range(min(weights[k], free)):
                while table[slot := (offset + at * skip) % size] >= 0:
                    at += 1
                table[slot] = k
                free -= 1
            preference[k] = offset, skip, at
    return table


def key_number(*columns: str | Column) -> Column:
    """60 bits of the MD5 of the key's columns as text; a null is a value of its own."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("null")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long")


def place(df: DataFrame, shards: list[str], *key: str, weights: list[int] | None = None) -> DataFrame:
    """df with slot int and shard string of each row's key; columns of these names are replaced. Equal keys share a shard, null keys too; repeated rows stay, an empty table stays empty, other columns of any length aren't looked at.

    A key column with a third of all rows should be joined by a finer one (a source with a document id):
    rows of one key can't be told apart.
    """
    table = lookup_table(shards, weights)
    lookup = df.sparkSession.createDataFrame([(k, shards[s]) for k, s in enumerate(table)], "`__slot` int, `__shard` string")
    slotted = df.withColumn("slot", F.pmod(key_number(*key), F.lit(len(table))).cast("int"))
    joined = slotted.join(F.broadcast(lookup), F.col("slot") == F.col("__slot"))
    return joined.withColumn("shard", F.col("__shard")).drop("__slot", "__shard")


def write(df: DataFrame, shards: list[str], path: str, *key: str, rows_per_file: int = 1_000_000) -> None:
    """Write each shard's rows to a folder of its own, by as many tasks as its rows need."""
    place(df, shards, *key).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
