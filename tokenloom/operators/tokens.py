"""Token tables: one row per token, and what needs a token's position in its file.

Operators that need order take ``tokens(files, ordered=True)``: the files are distributed by ``file_id`` before
they are cut into tokens, so the only exchange moves each text once and every window over a file reuses it.
One window frame never holds more than one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import codec as cd
from tokenloom.functions import lexing as lx
from tokenloom.operators.filters import where_once


def token_types(spark: SparkSession) -> DataFrame:
    """The 128 token types; whitespace splits into EOL and WHITESPACE_NO_EOL when categories are counted."""
    return spark.createDataFrame(lx.TOKEN_TYPES, "type_no int, token_type string, category string, literal string")


def pieces(files: DataFrame, ordered: bool = False) -> DataFrame:
    """(file_id, pos, text): every piece of every text, whitespace, comments and errors included."""
    if ordered:
        files = files.repartition("file_id")
    return files.select("file_id", F.posexplode(lx.lex(F.col("content"))).alias("pos", "text"))


def with_type(df: DataFrame) -> DataFrame:
    """Add type_no to (text): a constant-size lookup for words and symbols, patterns for the open classes."""
    return df.withColumn("type_no", lx.type_no(F.col("text")))


def tokens(files: DataFrame, ordered: bool = False) -> DataFrame:
    """(file_id, pos, token_type, text) without lexer errors."""
    types = F.broadcast(token_types(files.sparkSession).select("type_no", "token_type"))  # 128 rows
    return (with_type(pieces(files, ordered)).join(types, "type_no")
            .select("file_id", "pos", "token_type", "text"))


def significant(df: DataFrame, keep_newlines: bool = False) -> DataFrame:
    """Drop comments and blanks; with ``keep_newlines`` whitespace that holds a line end stays."""
    space = F.col("token_type") == "WS"
    if keep_newlines:
        space &= F.instr("text", "\n") == 0
    return df.where(~(F.col("token_type").isin("COMMENT", "LINE_COMMENT") | space))


def categories(df: DataFrame) -> DataFrame:
    """Add the category through the token-type dimension."""
    types = F.broadcast(token_types(df.sparkSession).select("token_type", "category"))  # 128 rows
    return df.join(types, "token_type")


def file_order() -> Window:
    return Window.partitionBy("file_id").orderBy("pos")


def so_far(include_current: bool = True) -> Window:
    return file_order().rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)


def line_numbers(df: DataFrame) -> DataFrame:
    """Add line_no: the line ends in whitespace before the token."""
    ends = F.when(F.col("token_type") == "WS", F.regexp_count("text", F.lit("\n"))).otherwise(0)
    return df.withColumn("line_no", F.coalesce(F.sum(ends).over(so_far(include_current=False)), F.lit(0)))


def nesting(text: Column, opening: str, closing: str) -> Column:
    step = F.when(text.isin(*opening), 1).when(text.isin(*closing), -1).otherwise(0)
    return F.sum(step).over(so_far()).cast("int")


def nesting_depth(df: DataFrame) -> DataFrame:
    """Add the depth of each bracket kind after the token."""
    text = F.col("text")
    return df.withColumns({"paren_depth": nesting(text, "(", ")"), "bracket_depth": nesting(text, "[", "]"),
                           "brace_depth": nesting(text, "{", "}")})


def balance(df: DataFrame) -> DataFrame:
    """(file_id, min_depth, end_depth): over all three bracket kinds; a file balances if both are 0."""
    deep = nesting_depth(df)
    depths = ["paren_depth", "bracket_depth", "brace_depth"]
    lowest = deep.groupBy("file_id").agg(
        F.least(F.lit(0), *(F.min(d) for d in depths)).alias("min_depth"),
        sum((F.abs(F.max_by(d, "pos")) for d in depths[1:]), F.abs(F.max_by(depths[0], "pos"))).alias("end_depth"))
    return lowest


def neighbours(df: DataFrame) -> DataFrame:
    """Add the type before and after each token of its file."""
    return df.withColumns({"previous_type": F.lag("token_type").over(file_order()),
                           "next_type": F.lead("token_type").over(file_order())})


def encoded_tokens(df: DataFrame) -> DataFrame:
    """(file_id, pos, text, encoded): the encoded form of each token that has one."""
    kept = where_once(df.withColumn("encoded", cd.unspelled(F.col("text"))), F.col("encoded") != "")
    return kept.select("file_id", "pos", "text", cd.spell(F.col("encoded")).alias("encoded"))


def encoded_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no, unicode): the encoded text cut after its end-of-line tokens.  No exchange."""
    encoded = files.select("file_id", cd.encode_file(F.col("content")).alias("unicode"))
    return encoded.select("file_id", F.posexplode(F.split("unicode", "\n")).alias("line_no", "unicode")).where(F.col("unicode") != "")


def retokenized(files: DataFrame) -> DataFrame:
    """(file_id, content): the token texts, hidden ones included, joined by one space and trimmed."""
    from tokenloom.functions.text import trim_control
    text = F.col("content")
    kept = F.filter(lx.lex(text), lambda t: lx.type_no(t) > 0)
    return files.withColumn("content", trim_control(F.array_join(kept, " ")))
