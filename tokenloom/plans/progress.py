"""The running token rate of a corpus, reported every so many lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import bpe, sharding
from tokenloom.session import Tables


def running_rate(encoded: DataFrame, model: bpe.BpeModel, every: int = 100_000) -> DataFrame:
    """(lines, tokens, tokens_per_line) after every ``every`` lines in file order.

    Each file becomes its list of line sizes; lines and tokens before a file come from range totals, and only the
    report points are expanded, so no single task walks the corpus.
    """
    cut = F.filter(F.split("unicode", "\n"), lambda line: line != "")
    sizes = bpe.line_sizes(encoded.sparkSession, cut, model)
    # Numbers only, read three times below: written once instead of encoding three times.
    sized = Tables(encoded.sparkSession).replace(
        "line_sizes", encoded.where(F.size(cut) > 0).select("file_id", sizes.alias("sizes")))
    total = lambda column: F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x)
    before = sharding.with_totals_before(sized, "file_id", {"lines_before": F.size("sizes"), "tokens_before": total(F.col("sizes"))})
    first = (F.floor(F.col("lines_before") / every) + 1) * every
    last = F.col("lines_before") + F.size("sizes")
    points = before.where(first <= last).withColumn("lines", F.explode(F.sequence(first, last, F.lit(every).cast("bigint"))))
    inside = (F.col("lines") - F.col("lines_before")).cast("int")
    tokens = F.col("tokens_before") + total(F.slice("sizes", F.lit(1), inside))
    return points.select("lines", tokens.alias("tokens"), (tokens / F.col("lines")).alias("tokens_per_line"))
