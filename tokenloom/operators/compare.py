"""Comparing tokenizers by the number of tokens they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import lattice
from tokenloom.session import Tables


def baseline_totals(files: DataFrame, by: str = "pieces", size: int = 1024) -> DataFrame:
    """(total_tokens) of a baseline tokenizer: pieces of a unigram vocabulary of about ``size`` entries learned from the files
    (``lattice``), blank-separated words, or characters."""
    if by == "pieces":
        words = Tables(files.sparkSession).replace("words", lattice.word_counts(files))
        return lattice.total_tokens(words, lattice.learn(words, size))
    content = F.col("content")
    count = {"words": F.regexp_count(content, F.lit(r"\S+")), "characters": F.length(content)}[by]
    return files.agg(F.coalesce(F.sum(count), F.lit(0)).cast("bigint").alias("total_tokens"))


def improvement(series: DataFrame, baseline: DataFrame) -> DataFrame:
    """(vocab_size, fewer_tokens, improvement_pct): the series against a baseline of the same vocabulary size.

    Both are (vocab_size, total_tokens); the baseline is one row per tokenizer compared.
    """
    base = baseline.withColumnRenamed("total_tokens", "baseline_tokens")
    joined = series.join(base, "vocab_size")
    fewer = F.col("baseline_tokens") - F.col("total_tokens")
    return joined.select("vocab_size", fewer.alias("fewer_tokens"), (fewer / F.col("baseline_tokens") * 100).alias("improvement_pct"))


def nearest(series: DataFrame, baseline: DataFrame) -> DataFrame:
    """(vocab_size, total_tokens, saving_pct): the point whose count is nearest to the baseline's single row.

    The series is (ordinal, vocab_size, total_tokens); the smaller ordinal wins a tie.
    """
    size, tokens = baseline.select("vocab_size").scalar(), baseline.select("total_tokens").scalar()
    order = F.struct(F.abs(F.col("total_tokens") - tokens), F.col("ordinal"))
    best = series.agg(F.min_by(F.struct("vocab_size", "total_tokens"), order).alias("best"), F.first(size).alias("base_size"))
    saving = (F.col("base_size") - F.col("best.vocab_size")) / F.col("base_size") * 100
    return best.select(F.col("best.vocab_size").alias("vocab_size"), F.col("best.total_tokens").alias("total_tokens"),
                       saving.alias("saving_pct"))
