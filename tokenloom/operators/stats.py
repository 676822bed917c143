"""Token statistics per file and over the corpus, and the size of the data set.

Every token is looked at once; sums and maxima are combined within each task before one row per file (or one row
in all) is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import lexing as lx
from tokenloom.functions import text as tx
from tokenloom.operators import tokens as tk

CATEGORIES = "EOL WHITESPACE_NO_EOL COMMENT IDENTIFIER KEYWORD LITERAL SEPARATOR OPERATOR".split()
SUMS = ["total_tokens", *(c.lower() for c in CATEGORIES), "string_literals", "literal_chars", "literal_bytes",
        "identifier_chars", "identifier_bytes", "total_bytes"]
MAXIMA = ["max_literal_chars", "max_identifier_chars"]


def measured(files: DataFrame) -> DataFrame:
    """One row per piece with its contribution.  A whitespace run counts as one token per line end and one per
    other blank."""
    text = F.col("text")
    category = F.col("category")
    typed = (tk.pieces(files).withColumn("category", lx.category(text)).where(category.isNotNull())
             .withColumn("chars", tx.utf16_length(text)).withColumn("bytes", F.octet_length(text))
             .withColumn("ends", F.when(category == "WHITESPACE", F.regexp_count(text, F.lit(r"\r\n|\r|\n"))).otherwise(0))
             .withColumn("blanks", F.when(category == "WHITESPACE",
                                          F.length(F.regexp_replace(text, r"[\r\n]+", ""))).otherwise(0)))
    is_string = (category == "LITERAL") & text.startswith('"') & ~text.startswith('"""')
    return typed.withColumn("is_string", is_string)


def _aggregates() -> list[Column]:
    category = F.col("category")
    of = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0))
    top = lambda condition, value: F.coalesce(F.max(F.when(condition, value)), F.lit(0))
    name = category == "IDENTIFIER"
    counted = {c: of(category == c, F.lit(1)) for c in CATEGORIES[2:]}
    counted = {"EOL": F.sum("ends"), "WHITESPACE_NO_EOL": F.sum("blanks")} | counted
    total = F.sum(F.when(category == "WHITESPACE", F.col("ends") + F.col("blanks")).otherwise(1))
    out = {"total_tokens": total} | {c.lower(): counted[c] for c in CATEGORIES}
    out |= {"string_literals": of(F.col("is_string"), F.lit(1)),
            "literal_chars": of(F.col("is_string"), F.col("chars")), "literal_bytes": of(F.col("is_string"), F.col("bytes")),
            "identifier_chars": of(name, F.col("chars")), "identifier_bytes": of(name, F.col("bytes")),
            "total_bytes": F.sum("bytes"),
            "max_literal_chars": top(F.col("is_string"), F.col("chars")),
            "max_identifier_chars": top(name, F.col("chars"))}
    return [F.coalesce(value, F.lit(0)).cast("bigint").alias(column) for column, value in out.items()]


def file_stats(files: DataFrame) -> DataFrame:
    """One row per file that has a token."""
    return measured(files).groupBy("file_id").agg(*_aggregates())


def corpus_stats(files: DataFrame) -> DataFrame:
    """One row for the whole corpus, straight from the tokens."""
    return measured(files).agg(*_aggregates())


def merged_stats(per_file: DataFrame) -> DataFrame:
    """The same row from per-file rows: sums and maxima, so partial results of any grouping can be merged."""
    return per_file.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in SUMS),
                        *(F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in MAXIMA))


def with_averages(stats: DataFrame) -> DataFrame:
    """Average lengths, 0 where nothing was counted.  Literals are averaged over string literals only."""
    average = lambda total, count: F.when(F.col(count) > 0, F.col(total) / F.col(count)).otherwise(F.lit(0.0))
    return stats.withColumns({"avg_literal_chars": average("literal_chars", "string_literals"),
                              "avg_identifier_chars": average("identifier_chars", "identifier")})


def report(stats: DataFrame) -> DataFrame:
    """(metric, value): the statistics row turned into lines, averages included."""
    wide = with_averages(stats)
    columns = [F.col(c).cast("double").alias(c) for c in wide.columns if c != "file_id"]
    return wide.select(*columns).unpivot([], [c for c in wide.columns if c != "file_id"], "metric", "value")


def category_counts(files: DataFrame) -> DataFrame:
    """(category, n) over the corpus, as rows."""
    totals = corpus_stats(files).select(*(F.col(c.lower()).alias(c) for c in CATEGORIES))
    return totals.unpivot([], CATEGORIES, "category", "n").where(F.col("n") > 0)


def dataset_size(files: DataFrame) -> DataFrame:
    """(files, total_bytes) of the given files."""
    return files.agg(F.count("*").alias("files"),
                     F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("bigint").alias("total_bytes"))
