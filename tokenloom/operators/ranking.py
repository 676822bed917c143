"""Frequencies of identifiers and string literals, and their rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import lexing as lx
from tokenloom.operators import tokens as tk


def values(files: DataFrame) -> DataFrame:
    """(kind, item): one row per identifier and string literal of the corpus."""
    text = F.col("text")
    kind = F.when(lx.is_identifier(text), "identifiers").when(lx.is_string(text), "literals")
    return tk.pieces(files).select(kind.alias("kind"), text.alias("item")).where(F.col("kind").isNotNull())


def frequencies(values_df: DataFrame) -> DataFrame:
    """(kind, item, cnt).  Partial counts come before the exchange, so a very frequent item is one row per task."""
    item = F.replace("item", F.lit("\r"), F.lit(""))
    return values_df.groupBy("kind", item.alias("item")).agg(F.count("*").alias("cnt"))


def by_count() -> list[Column]:
    """Count descending; ties in descending binary order of the item."""
    return [F.col("cnt").desc(), F.col("item").desc()]


def ranked(freq: DataFrame) -> DataFrame:
    return freq.orderBy("kind", *by_count())


def top(freq: DataFrame, n: int) -> DataFrame:
    """The n most frequent rows.  Sorting keeps n rows per task; no full sort takes place."""
    return freq.orderBy(*by_count()).limit(n)


def weighted(freq: DataFrame) -> DataFrame:
    """Add weight = characters x count."""
    return freq.withColumn("weight", F.length("item") * F.col("cnt"))


def ranked_by_weight(freq: DataFrame) -> DataFrame:
    return weighted(freq).orderBy(F.col("weight").desc(), F.col("item"))


def frequencies_of(freq: DataFrame, kind: str) -> DataFrame:
    return freq.where(F.col("kind") == kind)
