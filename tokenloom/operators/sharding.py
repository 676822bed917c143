"""Row numbers, shards, samples and splits.

Numbering rows of the whole corpus in order is the one place that looks serial.  The keys alone are range-partitioned and
written; range totals are summed up first (one row per range), then each range numbers its own keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import Tables


def totals_before(df: DataFrame, key: str, values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """(key, names): for each name the sum of the value over all rows with a smaller key; ``key`` is unique and not null.

    The engine samples the cut points of the ranges; the written table keeps which row fell into which, so reruns of a
    task see the same ranges.  Where the cuts fall does not change the result.
    """
    numbers = df.select(key, *(v.alias(f"_{n}") for n, v in values.items()))
    ranged = numbers.repartitionByRange(*([ranges] if ranges else []), key).withColumn("_range", F.spark_partition_id())
    ranged = Tables(df.sparkSession).replace("ranges", ranged)
    totals = ranged.groupBy("_range").agg(*(F.sum(f"_{n}").alias(f"_{n}_range") for n in values))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_{n}_range").over(earlier), F.lit(0)).alias(f"_{n}_offset")
                                        for n in values))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "_range")         # as many rows as partitions
    return out.select(key, *((F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) + F.col(f"_{n}_offset")).cast("bigint").alias(n)
                             for n in values))


def with_totals_before(df: DataFrame, key: str, values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Add those sums to the rows; whole rows are joined to their numbers, not sorted."""
    return df.join(totals_before(df, key, values, ranges), key)


def with_row_index(df: DataFrame, key: str = "file_id", ranges: int | None = None) -> DataFrame:
    """Add row_index, counted from 0 in the order of a unique key of any type."""
    if df.columns == [key]:
        return totals_before(df, key, {"row_index": F.lit(1)}, ranges)
    return with_totals_before(df, key, {"row_index": F.lit(1)}, ranges)


def shard_name(number: Column, width: int = 4) -> Column:
    """``part_0007``; numbers longer than the width stay whole."""
    digits = number.cast("string")
    return F.concat(F.lit("part_"), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def assign_shards(files: DataFrame, rows_per_shard: int = 10_000, key: str = "file_id", ranges: int | None = None) -> DataFrame:
    """Shards of exactly ``rows_per_shard`` rows in key order, the last one shorter; replaces ``shard``."""
    numbered = with_row_index(files, key, ranges)
    return numbered.withColumn("shard", shard_name(F.floor(F.col("row_index") / rows_per_shard)))


def shard_count(files: DataFrame, rows_per_shard: int = 10_000) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.ceil(F.count("*") / rows_per_shard).alias("shards"))


def files_per_shard(files: DataFrame) -> DataFrame:
    """(shard, files) and a total in the row whose shard is NULL."""
    return files.rollup("shard").agg(F.count("*").alias("files"))


def shard_ranks(files: DataFrame) -> DataFrame:
    """(shard, rn, k): rank by name, null first, among k shards.  Names are numbered in ranges, as rows are, so no task sees
    them all."""
    names = files.select(F.coalesce(F.concat(F.lit("v"), F.col("shard")), F.lit("-")).alias("name")).distinct()
    names = Tables(files.sparkSession).replace("names", names)
    shard = F.when(F.col("name") != "-", F.substr("name", F.lit(2)))
    return with_row_index(names, "name").select(shard.alias("shard"), (F.col("row_index") + 1).cast("int").alias("rn"), F.lit(names.count()).alias("k"))


def _last_shard(files: DataFrame, how_many: Column) -> Column:
    """Name of the last shard among the first ``how_many``; NULL if none.  One value, so the split becomes a plain
    filter on ``shard`` that prunes partitions and needs no join."""
    ranks = shard_ranks(files)
    return ranks.where(F.col("rn") <= how_many).agg(F.max("shard")).scalar()


def sample_shards(files: DataFrame, percent: int = 5) -> DataFrame:
    """Files of the first ceil(k x percent / 100) shards by name."""
    return files.where(F.col("shard") <= _last_shard(files, F.ceil(F.col("k") * percent / 100)))


def _in_training(files: DataFrame, ratio: float) -> Column:
    last = _last_shard(files, F.floor(F.col("k") * F.lit(ratio)))
    return F.coalesce(F.col("shard") <= last, F.lit(False))


def training_files(files: DataFrame, ratio: float = 0.9) -> DataFrame:
    """Files of the first floor(k x ratio) shards by name."""
    return files.where(_in_training(files, ratio))


def evaluation_files(files: DataFrame, ratio: float = 0.9) -> DataFrame:
    """The files of all other shards."""
    return files.where(~_in_training(files, ratio))


def count_training_files(files: DataFrame, ratio: float = 0.9, suffix: str | None = None) -> DataFrame:
    kept = training_files(files, ratio)
    if suffix:
        kept = kept.where(F.col("path").endswith(suffix))
    return kept.agg(F.count("*").alias("files"))


def training_steps(files: DataFrame, ratio: float = 0.999, batch: int = 8, accumulation: int = 4) -> DataFrame:
    """(files, steps): optimiser steps of one pass, whole batches only."""
    counted = count_training_files(files, ratio)
    return counted.withColumn("steps", F.floor(F.col("files") / (batch * accumulation)))


def shared_contents(files: DataFrame, ratio: float = 0.9) -> DataFrame:
    """(training_texts, evaluation_texts, shared_texts, shared_files): distinct texts of either side and of both.  Only
    digests move, and tasks combine equal ones first."""
    side = F.when(_in_training(files, ratio), 1).otherwise(0)
    digests = files.select(F.sha2(F.col("content").cast("binary"), 256).alias("digest"), side.alias("t"))
    texts = digests.groupBy("digest").agg(F.max("t").alias("t"), F.max(1 - F.col("t")).alias("e"), F.count("*").alias("n"))
    both = F.col("t") * F.col("e")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return texts.agg(total("t").alias("training_texts"), total("e").alias("evaluation_texts"), total(both).alias("shared_texts"),
                     total(both * F.col("n")).alias("shared_files"))
