"""File cleaning: newlines, header lines, comments, annotations, layout.

All of it happens inside the row.  Annotations and layout depend on bracket nesting of any depth, which no regular
expression follows, so the tokens of a text are folded with a small state; nothing is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import codec as cd
from tokenloom.functions import lexing as lx
from tokenloom.functions import text as tx
from tokenloom.operators import filters

CHUNK = 512                  # pieces folded at a time: what the fold appends to stays short
_AT, _DOT, _OPEN, _CLOSE = (lx.shape_char(n) for n in ("AT", "DOT", "LPAREN", "RPAREN"))
_NAMES = "".join([lx.shape_char("IDENTIFIER"), *(lx.shape_char(k.upper().replace("-", "_"))
                                                 for k in lx.SOFT_KEYWORDS if k != "non-sealed")])


def normalize(files: DataFrame) -> DataFrame:
    return files.withColumn("content", tx.normalize_newlines(F.col("content")))


def strip_headers(files: DataFrame) -> DataFrame:
    return files.withColumn("content", tx.strip_header(F.col("content")))


def strip_comments(files: DataFrame) -> DataFrame:
    """Each comment becomes one space, so its neighbours stay apart; literals holding ``//`` are untouched."""
    parts = F.transform(lx.lex(F.col("content")), lambda t: F.when(lx.is_comment(t), " ").otherwise(t))
    return files.withColumn("content", F.array_join(parts, ""))


def _fate(shape: Column, annotations: bool) -> Column:
    """One character per token: ``r`` removed, ``i`` inside round brackets, ``o`` outside.

    The shape is cut into names of annotations (with the bracket that opens their arguments), brackets, and all else; the
    fold over these keeps how many brackets of an argument list are open, and the depth.  An argument list that never
    closes ends with the file.
    """
    note = f"{_AT}[{_NAMES}](?:{_DOT}[{_NAMES}])*{_OPEN}?"
    pieces = F.regexp_extract_all(shape, F.lit(f"{note}|[{_OPEN}{_CLOSE}{_AT}]|[^{_OPEN}{_CLOSE}{_AT}]+" if annotations else
                                               f"[{_OPEN}{_CLOSE}]|[^{_OPEN}{_CLOSE}]+"), F.lit(0))

    def state_of(own: Column, depth: Column, name: str, value: Column) -> Column:
        return F.struct(own.alias("own"), depth.alias("depth"), value.alias(name))

    def step(state: Column, piece: Column) -> Column:
        size = F.length(piece)
        change = F.when(piece.endswith(_OPEN), 1).when(piece == _CLOSE, -1).otherwise(0)
        depth = state["depth"] + change
        bare = F.when(depth > 0, "i").otherwise("o")
        if not annotations:
            return state_of(state["own"], depth, "fate", F.concat(state["fate"], F.repeat(bare, size)))
        named = piece.startswith(_AT) & (size > 1)
        own = F.when(state["own"] > 0, state["own"] + change).when(named, change).otherwise(0)
        fate = F.when((state["own"] > 0) | named, "r").otherwise(bare)
        return state_of(own, depth, "fate", F.concat(state["fate"], F.repeat(fate, size)))

    def chunk(pieces: Column, state: Column, number: Column) -> Column:
        own = F.slice(pieces, number * CHUNK + 1, F.lit(CHUNK))
        done = F.aggregate(own, state_of(state["own"], state["depth"], "fate", F.lit("")), step,
                           lambda x: state_of(x["own"], x["depth"], "parts", F.concat(state["parts"], F.array(x["fate"]))))
        return done

    begin = state_of(F.lit(0), F.lit(0), "parts", F.array().cast("array<string>"))

    def folded(pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.size(pieces) / CHUNK).cast("int"))
        return F.aggregate(numbers, begin, lambda state, number: chunk(pieces, state, number), lambda state: F.array_join(state["parts"], ""))

    # A lambda's variable is evaluated once; the expression itself would be in every step.
    return F.element_at(F.transform(F.array(pieces), folded), 1)


def _laid_out(files: DataFrame, annotations: bool) -> DataFrame:
    """(columns of files, content): one space between tokens, a line end after ``;``, ``{`` and ``}`` outside brackets;
    files without a token that stays vanish.  Texts that are cut already (``_tokens``) are not cut again."""
    others = [c for c in files.columns if c not in ("content", "_tokens")]
    lexed = files if "_tokens" in files.columns else files.select(*others, lx.significant(F.col("content")).alias("_tokens"))
    judged = lexed.select(*others, F.col("_tokens.text").alias("_texts"), _fate(F.array_join("_tokens.c", ""), annotations).alias("_fate"))
    kept = filters.where_once(judged, F.col("_fate").rlike("[io]"))
    ends = lambda text, fate: (fate == "o") & text.isin(";", "{", "}")
    pieces = F.zip_with("_texts", cd.characters(F.col("_fate")), lambda text, fate: F.when(fate == "r", "").when(
        ends(text, fate), F.concat(text, F.lit("\n"))).otherwise(F.concat(text, F.lit(" "))))
    return kept.select(*others, F.regexp_replace(F.array_join(pieces, ""), r"[ \n]\z", "").alias("content"))


def format_files(files: DataFrame) -> DataFrame:
    """The layout of each file with at least one token; comments are not kept."""
    return _laid_out(files, False)


def remove_annotations(files: DataFrame) -> DataFrame:
    """The layout without ``@a.b.C`` and ``@a.b.C(...)`` of any nesting; ``@interface`` declarations stay."""
    return _laid_out(files, True)


def clean(files: DataFrame) -> DataFrame:
    """Newlines, header, comments, annotations, layout; files without tokens vanish."""
    return files.transform(normalize).transform(strip_headers).transform(remove_annotations)
