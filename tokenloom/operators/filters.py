"""Row filters.  All predicates stay inside the row and come before anything that multiplies rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import codec as cd
from tokenloom.functions import lexing as lx
from tokenloom.functions import text as tx


def with_suffix(files: DataFrame, suffix: str, ignore_case: bool = False) -> DataFrame:
    return files.where(tx.has_suffix(F.col("path"), suffix, ignore_case))


def named_files(files: DataFrame) -> DataFrame:
    """Add file_name, the name a file gets inside its shard."""
    return files.withColumn("file_name", tx.file_name(F.col("path"), F.col("file_id")))


def drop_hash_names(files: DataFrame) -> DataFrame:
    return files.where(~tx.is_hash_name(F.col("file_name")))


def body() -> Column:
    return tx.strip_header(tx.normalize_newlines(F.col("content")))


def where_once(files: DataFrame, condition: Column) -> DataFrame:
    """Filter by a costly condition exactly where it is written: as a generated column it is evaluated once per row
    and not moved below an exchange that spreads the rows."""
    return files.select("*", F.explode(F.array(condition)).alias("_keep")).where("_keep").drop("_keep")


def drop_undeclared(files: DataFrame) -> DataFrame:
    """Drop files that declare no class, interface or enum; a file whose brackets do not close stays."""
    return where_once(files, lx.judge(body(), lambda declares, balanced: declares | ~balanced))


def drop_unbalanced(files: DataFrame) -> DataFrame:
    """Drop files whose brackets do not close: a weaker condition than parsing."""
    return where_once(files, lx.balanced(body()))


def drop_garbage(files: DataFrame) -> DataFrame:
    """Hash-like names first: that test is cheap and spares the lexing."""
    return files.transform(named_files).transform(drop_hash_names).transform(drop_undeclared)


def keep_usable(files: DataFrame, tokens: bool = False) -> DataFrame:
    """What both garbage filters and the bracket check leave, with one look at each text.  With ``tokens`` the tokens of the
    text without its header stay as ``_tokens``, so that ``cleaning.clean`` need not cut it again."""
    named = files.transform(named_files).transform(drop_hash_names)
    usable = lambda declares, balanced: declares & balanced
    if not tokens:
        return where_once(named, lx.judge(body(), usable))
    lexed = named.withColumn("_tokens", lx.significant(body()))
    return where_once(lexed, lx.judge_shape(F.array_join("_tokens.c", ""), usable))


def drop_empty(files: DataFrame) -> DataFrame:
    return where_once(files.withColumn("content", tx.compact_text(F.col("content"))), F.col("content") != "")


def readable(files: DataFrame) -> DataFrame:
    """The files whose bytes are valid UTF-8; needs a ``data`` column of bytes, adds ``content``."""
    return files.where(F.is_valid_utf8(F.col("data"))).withColumn("content", F.decode("data", "UTF-8")).drop("data")


def unreadable(files: DataFrame) -> DataFrame:
    """(file_id or path columns, error): the files ``readable`` leaves out, with the reason in its own column."""
    return files.where(~F.is_valid_utf8(F.col("data"))).withColumn("error", F.lit("invalid UTF-8")).drop("data")


def in_alphabet(encoded: DataFrame, column: str = "unicode") -> DataFrame:
    """Drop characters outside the id alphabet."""
    return encoded.withColumn(column, F.regexp_replace(column, f"[^{cd.ALPHABET[0]}-{cd.ALPHABET[-1]}]", ""))


def is_special(token: Column) -> Column:
    """True for vocabulary entries with any character outside the id alphabet."""
    return token.rlike(f"[^{cd.ALPHABET[0]}-{cd.ALPHABET[-1]}]")
