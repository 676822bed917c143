"""Fixed-length training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text as tx
from tokenloom.operators import bpe, filters
from tokenloom.session import Tables

# --- Fixed values ---
MAX_LENGTH = 1536
IGNORED_LABEL = -100
# --------------------


def encoded_files(files: DataFrame, model: bpe.BpeModel, column: str = "unicode", keep_newlines: bool = True,
                  limit: int | None = None) -> DataFrame:
    """(file_id, ids) of each encoded file that is not empty after stripping.

    A file's text still has a newline after each end-of-line token.  With ``keep_newlines`` each of them becomes an
    unknown token, as when whole files are tokenised; without, only the tokens stay.
    """
    text = tx.strip(F.col(column))
    shown = text if keep_newlines else F.replace(text, F.lit("\n"), F.lit(""))
    kept = filters.where_once(files, text != "")
    return kept.select("file_id", bpe.encode_ids(files.sparkSession, shown, model, limit=limit).alias("ids"))


def padded(encoded: DataFrame, max_length: int = MAX_LENGTH, pad_id: int = bpe.PAD_ID) -> DataFrame:
    """(file_id, input_ids, attention_mask): cut to the length, padded on the right."""
    kept = F.slice("ids", 1, max_length)
    missing = F.lit(max_length) - F.least(F.size("ids"), F.lit(max_length))
    return encoded.select(
        "file_id", F.concat(kept, F.array_repeat(F.lit(pad_id), missing)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.lit(max_length) - missing), F.array_repeat(F.lit(0), missing)).alias("attention_mask"))


def with_labels(examples: DataFrame, pad_id: int = bpe.PAD_ID) -> DataFrame:
    """Add labels: the ids, padding replaced by the label the loss ignores."""
    return examples.withColumn("labels", F.transform("input_ids", lambda x: F.when(x == pad_id, IGNORED_LABEL).otherwise(x)))


def build(files: DataFrame, model: bpe.BpeModel, max_length: int = MAX_LENGTH, column: str = "unicode",
          keep_newlines: bool = True) -> DataFrame:
    """(file_id, input_ids, attention_mask, labels).  Each file is one row throughout: no exchange.

    The ids are written first, so texts go to Python a little at a time, whatever the session sends at once, and not in
    the tasks that hold the padded columns."""
    ids = Tables(files.sparkSession).replace("ids", encoded_files(files, model, column, keep_newlines, max_length))
    return ids.transform(padded, max_length).transform(with_labels)


def truncation(files: DataFrame, model: bpe.BpeModel, max_length: int = MAX_LENGTH, column: str = "unicode") -> DataFrame:
    """(files, truncated_files, tokens, lost_tokens): what cutting to the length costs."""
    sized = encoded_files(files, model, column).select(F.size("ids").cast("bigint").alias("size"))
    lost = F.greatest(F.col("size") - max_length, F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return sized.agg(F.count("*").alias("files"), total((lost > 0).cast("int")).alias("truncated_files"),
                     total("size").alias("tokens"), total(lost).alias("lost_tokens"))
