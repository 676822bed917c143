"""Sharding (10): a lookup table of prime size that the shards fill in turns, each by its own order of preference.

Every shard has a permutation of the slots, (offset + j * skip) mod size.  The shards take turns; a shard whose turn it
is claims the first slot of its permutation that is still free, until no slot is left.  All shards so get the same
number of slots, give or take one, and another shard moves few keys.  A row's slot is the hash of its key mod size; the
table, whose size is bounded by ``MOST_SLOTS``, is broadcast, so placing a row is one lookup and no shuffle.

Defined cases: a null key is hashed as the string ``null``; repeated keys share a shard; an empty table gives an empty
result; ``slot`` and ``shard`` replace columns of that name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SLOTS = 1_000_000


def next_prime(least: int) -> int:
    number = max(2, least)
    while any(number % d == 0 for d in range(2, int(number ** 0.5) + 1)):
        number += 1
    return number


def lookup_table(names: list[str], slots_per_shard: int = 100) -> list[int]:
    """For each slot the place of its shard in ``names``.  The same names in any order give the same owners."""
    size = next_prime(max(3, len(names) * slots_per_shard))
    if not names or len(set(names)) < len(names) or size > MOST_SLOTS:
        raise ValueError(f"between 1 and {MOST_SLOTS // slots_per_shard} different shard names are needed")
    turns = sorted(range(len(names)), key=names.__getitem__)
    hashed = [hashlib.md5(name.encode()).digest() for name in names]
    offset = [int.from_bytes(h[:8], "big") % size for h in hashed]
    skip = [int.from_bytes(h[8:], "big") % (size - 1) + 1 for h in hashed]
    owner, tried, free = [-1] * size, [0] * len(names), size
    while free:
        for shard in turns[:free]:                   # the last turn may end early
            while owner[slot := (offset[shard] + tried[shard] * skip[shard]) % size] >= 0:
                tried[shard] += 1
            owner[slot] = shard
        free -= min(free, len(names))
    return owner


def slot_of(key: Column, size: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % size).cast("int")


def placed(spark: SparkSession, df: DataFrame, names: list[str], key: str = "doc_id", slots_per_shard: int = 100) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (place of the shard's name)."""
    table = lookup_table(names, slots_per_shard)
    owners = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("_slot", "_shard"))
    owners = owners.select("_slot", F.col("_shard").cast("int").alias("_shard"))
    rows = df.select(F.struct(*df.columns).alias("_row"), slot_of(F.col(key), len(table)).alias("_slot"))
    joined = rows.join(F.broadcast(owners), "_slot")           # at most MOST_SLOTS rows of two numbers
    kept = [F.col(f"_row.`{c}`") for c in df.columns if c not in ("slot", "shard")]
    return joined.select(*kept, F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))


def write_shards(df: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """A folder for each shard; a row's file within it depends on a salt, so a large shard is many files."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard))
    df.withColumn("_salt", salt).repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
