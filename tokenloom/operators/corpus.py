"""Line tables and the corpus text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text as tx
from tokenloom.operators.filters import where_once


def lines(files: DataFrame) -> DataFrame:
    """(file_id, shard, line_no, line): the stripped lines that are not empty."""
    return files.select("file_id", "shard", F.posexplode(tx.stripped_lines(F.col("content"))).alias("line_no", "line"))


def line_counts(lines_df: DataFrame) -> DataFrame:
    """(line, n): each distinct line and how often it occurs.  Counting happens before the exchange, so a line
    that makes up much of the corpus travels as one row per task."""
    return lines_df.groupBy("line").agg(F.count("*").alias("n"))


def joined(files: DataFrame) -> DataFrame:
    """(file_id, content): the stripped lines of a file, each ended by a newline; empty files vanish."""
    text = F.array_join(tx.stripped_lines(F.col("content")), "\n")
    kept = where_once(files.withColumn("content", text), F.col("content") != "")
    return kept.withColumn("content", F.concat("content", F.lit("\n")))


def fill_in_the_middle(files: DataFrame, seed: int = 0) -> DataFrame:
    return files.withColumn("content", tx.fill_in_the_middle(F.col("content"), F.col("file_id"), seed))
