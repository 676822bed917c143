"""Text inputs: folders of files, corpus lines, id maps, frequency lists, id corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import text as tx


def read_files(spark: SparkSession, folder: str, pattern: str = "processed_part_*", suffix: str = ".txt") -> DataFrame:
    """(shard, path, content): whole files in the sub-folders that match, one row each."""
    read = spark.read.option("pathGlobFilter", f"*{suffix}").text(f"{folder}/{pattern}", wholetext=True)
    path = F.col("_metadata.file_path")
    return read.select(F.regexp_extract(path, r"([^/]+)/[^/]+\z", 1).alias("shard"),
                       F.col("_metadata.file_name").alias("path"), F.col("value").alias("content"))


def read_bytes(spark: SparkSession, folder: str, pattern: str = "processed_part_*", suffix: str = ".txt") -> DataFrame:
    """(shard, path, data): the same as bytes, for telling malformed files apart."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(f"{folder}/{pattern}")
    return read.select(F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1).alias("shard"),
                       F.regexp_extract("path", r"([^/]+)\z", 1).alias("path"), F.col("content").alias("data"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): stripped lines of a corpus, blank ones included."""
    return spark.read.option("lineSep", "\n").text(path).select(tx.strip(F.col("value")).alias("line"))


def parse_id_map(lines: DataFrame) -> DataFrame:
    """(token_id STRING, text) from lines ``id key value``; fewer than three parts give an empty text."""
    parts = F.split(tx.strip(F.col("value")), " ", 3)
    return (lines.where(tx.strip(F.col("value")) != "")
            .select(F.element_at(parts, 1).alias("token_id"),
                    F.when(F.size(parts) == 3, F.try_element_at(parts, F.lit(3))).otherwise("").alias("text")))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_id_map(spark.read.option("lineSep", "\n").text(path))


def parse_frequencies(lines: DataFrame) -> DataFrame:
    """(item, cnt) from lines ``item: count``.  The item reaches to the last ``": "``, so it may hold others."""
    pattern = r"\A(.*): ([0-9]+)\z"
    return (lines.where(F.col("value").rlike(pattern))
            .select(F.regexp_extract("value", pattern, 1).alias("item"),
                    F.regexp_extract("value", pattern, 2).cast("bigint").alias("cnt")))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return parse_frequencies(spark.read.option("lineSep", "\n").text(path))
