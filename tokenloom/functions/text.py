"""Text helpers as column expressions: stripping, line splitting, headers, file names, fill-in-the-middle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: characters removed by the three kinds of stripping, and line breaks -----------------------
_CONTROL = "".join(map(chr, range(0x00, 0x21)))
_SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
           0x2005, 0x2006, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x205F, 0x3000]
BREAKING_SPACE = "".join(map(chr, _SPACES))
UNICODE_SPACE = BREAKING_SPACE + "".join(map(chr, [0x85, 0xA0, 0x2007, 0x202F]))     # with no-break spaces and NEL
ANY_LINE_BREAK = r"\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
PLAIN_LINE_BREAK = r"\r\n|[\n\r]"
HEADER_START = "package import public class interface enum @interface".split()
# -------------------------------------------------------------------------------------------------------------


def strip(value: Column, characters: str = UNICODE_SPACE) -> Column:
    return F.btrim(value, F.lit(characters))


def trim_control(value: Column) -> Column:
    """Strip every character up to and including the space."""
    return F.btrim(value, F.lit(_CONTROL))


def normalize_newlines(content: Column) -> Column:
    return F.regexp_replace(content, r"\r\n?", "\n")


def strip_header(content: Column) -> Column:
    """Drop the lines before the first one that starts like Java code; no such line leaves an empty text.

    Expects ``\\n`` line ends.  Empty lines at the end go too.  The text is cut at the first such line, so nothing
    after it is searched.
    """
    starts = r"\n(?=[\x{00}-\x{09}\x{0B}-\x{20}]*(?:" + "|".join(HEADER_START) + r")[^\n\x{85}\x{2028}\x{2029}]*(?:\n|\z))"
    parts = F.split(F.concat(F.lit("\n"), content), starts, 2)
    found = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    return F.regexp_replace(found, r"\n(?<!\n\n)\n*+\z", "")          # far faster on long texts than trimming


def stripped_lines(content: Column, line_break: str = ANY_LINE_BREAK, characters: str = UNICODE_SPACE) -> Column:
    """array<string>: the stripped lines that are not empty, in order."""
    lines = F.split(content, line_break)
    return F.filter(F.transform(lines, lambda x: strip(x, characters)), lambda x: x != "")


def compact_text(content: Column) -> Column:
    """The stripped non-empty lines, each ended by a newline; empty for a text without any."""
    lines = stripped_lines(content, PLAIN_LINE_BREAK, BREAKING_SPACE)
    return F.coalesce(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit(""))


def file_name(path: Column, file_id: Column) -> Column:
    """``<class>_<id>.java`` from ``.../<class>.java``; other paths give ``JavaFile_<id>_<id>.java``."""
    stem = F.regexp_extract(path, r"(?U)/(\w+)\.java\n?\z", 1)
    fallback = F.concat(F.lit("JavaFile_"), file_id.cast("string"))
    return F.concat(F.when(stem == "", fallback).otherwise(stem), F.lit("_"), file_id.cast("string"), F.lit(".java"))


def is_hash_name(name: Column) -> Column:
    return name.rlike(r"\A[0-9a-fA-F]{32}_[0-9]+\.java\z")


def has_suffix(path: Column, suffix: str, ignore_case: bool = False) -> Column:
    return (F.lower(path) if ignore_case else path).endswith(suffix)


def encoded_path(folder: Column, path: Column) -> Column:
    """``<folder>/<parent>/<stem>_unicode.txt`` for a ``.java`` path inside an archive."""
    parent = F.regexp_extract(path, r"\A([\s\S]*/)[^/]*\z", 1)
    stem = F.replace(F.regexp_extract(path, r"([^/]*)\z", 1), F.lit(".java"), F.lit(""))
    return F.concat(folder, F.lit("/"), parent, stem, F.lit("_unicode.txt"))


def draw(key: Column, seed: int, label: str, bound: Column) -> Column:
    """A repeatable pseudo-random integer in [0, bound) from md5(key:seed:label); 0 for an empty range."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}:{label}")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.when(bound > 0, F.pmod(number, bound)).otherwise(F.lit(0)).cast("int")


def fill_in_the_middle(content: Column, key: Column, seed: int = 0) -> Column:
    """``<PRE>``, ``<MID>``, ``<SUF>`` around three line ranges; texts under three lines stay as they are."""
    lines = F.split(F.regexp_replace(content, r"\n+\z", ""), "\n")
    n = F.size(lines)
    start = draw(key, seed, "start", F.floor(n / 2)) + F.floor(n / 4).cast("int")
    length = F.least(draw(key, seed, "length", F.floor(n / 4)), n - start)
    part = lambda begin, size: F.array_join(F.slice(lines, begin + 1, size), "\n")
    split = F.concat(F.lit("<PRE>"), part(F.lit(0), start), F.lit("<MID>"), part(start, length),
                     F.lit("<SUF>"), part(start + length, n - start - length))
    return F.when(n < 3, content).otherwise(split)


def crc32(content: Column) -> Column:
    return F.crc32(F.encode(content, "UTF-8"))


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units: characters above U+FFFF count twice."""
    return F.length(value) + F.regexp_count(value, F.lit(r"[\x{10000}-\x{10FFFF}]"))
