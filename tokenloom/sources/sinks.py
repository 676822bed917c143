"""Outputs.  Row sets are written as partitioned Parquet or text by all tasks; only the small reports (vocabulary
lists, one-row statistics) are single files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text as tx
from tokenloom.operators import corpus, filters, ranking, sharding, stats


def _spread(files: DataFrame) -> DataFrame:
    """Rows of a shard come together, so that few files are written per folder; adaptive execution splits a shard
    that is far larger than the others over several tasks."""
    return files.hint("rebalance", "shard")


def write_shards(files: DataFrame, path: str, rows_per_shard: int = 10_000) -> None:
    """Numbered shards of ``rows_per_shard`` rows."""
    sharding.assign_shards(files, rows_per_shard).drop("row_index").write.partitionBy("shard").mode("overwrite").parquet(path)


def with_checksum(files: DataFrame) -> DataFrame:
    """Add the byte size and CRC-32 of each file."""
    return files.withColumns({"size": F.octet_length("content").cast("bigint"), "crc32": tx.crc32(F.col("content"))})


def processed_names(files: DataFrame) -> DataFrame:
    return files.withColumn("shard", F.concat(F.lit("processed_"), F.col("shard")))


def write_cleaned(files: DataFrame, path: str) -> None:
    _spread(files).transform(processed_names).transform(with_checksum).write.partitionBy("shard").mode("overwrite").parquet(path)


def write_values(files: DataFrame, path: str) -> None:
    """Identifier and literal values, one per line, a folder per kind; earlier output is replaced."""
    ranking.values(files).write.partitionBy("kind").mode("overwrite").text(path)


def report_lines(stats_row: DataFrame) -> DataFrame:
    metric = F.concat_ws(": ", "metric", F.col("value").cast("string"))
    return stats.report(stats_row).select(metric.alias("line"))


def write_report(stats_row: DataFrame, path: str) -> None:
    report_lines(stats_row).coalesce(1).write.mode("overwrite").text(path)       # two dozen lines


def encoded_names(encoded: DataFrame) -> DataFrame:
    """Add file_path, where the encoded text of a file goes; empty texts are left out."""
    return filters.where_once(encoded, F.col("unicode") != "").withColumn(
        "file_path", tx.encoded_path(F.col("shard"), F.col("path")))


def write_encoded(encoded: DataFrame, path: str) -> None:
    _spread(encoded).transform(encoded_names).write.partitionBy("shard").mode("overwrite").parquet(path)


def write_corpus(files: DataFrame, path: str, single_file: bool = False) -> None:
    """All stripped lines, a newline after each.  One file only on request: that funnels through one task."""
    lines = corpus.lines(files).select("line")
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)


def write_ordered_lines(lines: DataFrame, path: str) -> None:
    """A vocabulary list (column ``line``, already in order) as one file; at most as long as the vocabulary."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)


def write_frequencies(freq: DataFrame, path: str) -> None:
    """Lines ``item: count``, by all tasks; an item must not hold a line end."""
    freq.select(F.concat_ws(": ", "item", F.col("cnt").cast("string")).alias("line")).write.mode("overwrite").text(path)


def write_dataset_size(files: DataFrame, path: str) -> None:
    size = stats.dataset_size(files)
    text = F.concat(F.lit("Total files: "), F.col("files"), F.lit("\nTotal bytes: "), F.col("total_bytes"))
    size.select(text.alias("line")).coalesce(1).write.mode("overwrite").text(path)       # one row


def write_model(model, spark, path: str) -> None:
    """Vocabulary and merges of a byte-pair model as two tables."""
    model.vocabulary(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
    model.merge_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
