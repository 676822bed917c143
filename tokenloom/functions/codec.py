"""The 226-entry model vocabulary and the two directions of the codec, as column expressions.

A model token is one private-use character, U+E000 + id.  An encoded text is a string of them with a newline
after every end-of-line character.  Both directions stay inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions import lexing as lx
from tokenloom.functions import text as tx

# --- Fixed values ---------------------------------------------------------------------------------------------
PUA_START = 0xE000
NEWLINE_KEY, TRUE_KEY, FALSE_KEY = "!LEX_NEWLINE", "!LEX_TRUE", "!LEX_FALSE"
PRINTABLE = "".join(map(chr, range(32, 127)))
FIRST_TYPE_ID = 98
SUBSTITUTE = "_"
# The highest id that still fits one private-use or compatibility character (U+FFFF).
MAX_VOCABULARY = 0xFFFF - PUA_START + 1
# ---------------------------------------------------------------------------------------------------------------

BASE_VOCABULARY: list[tuple[int, str, str]] = [
    (i, key, value) for i, (key, value) in enumerate(
        [(NEWLINE_KEY, "<EOL>"), *((c, c) for c in PRINTABLE), (TRUE_KEY, "true"), (FALSE_KEY, "false")]
        + [(f"!LEX_{name}", literal or name) for _, name, _, literal in lx.TOKEN_TYPES])
]
BASE_SIZE = len(BASE_VOCABULARY)
ID_OF = {key: i for i, key, _ in BASE_VOCABULARY}

EOL_ID, TRUE_ID, FALSE_ID = ID_OF[NEWLINE_KEY], ID_OF[TRUE_KEY], ID_OF[FALSE_KEY]
IDENTIFIER_ID = ID_OF["!LEX_IDENTIFIER"]


def id_char(token_id: int) -> str:
    return chr(PUA_START + token_id)


EOL, MARKER = id_char(EOL_ID), id_char(IDENTIFIER_ID)
ALPHABET = "".join(id_char(i) for i in range(BASE_SIZE))
_LETTERS = "".join(id_char(ID_OF[c]) for c in PRINTABLE)
_CONTROL = "".join(c for c in map(chr, [*range(1, 32), 127]) if c != "\n")
RUN = 1 << 21              # bytes of texts that are spelled at a time


def _type_char(type_no: int) -> str:
    return id_char(FIRST_TYPE_ID - 1 + type_no)


def once(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function(value)`` with a costly value computed once, however often the function names it."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def spell(text: Column) -> Column:
    """Printable ASCII as model tokens, anything else an underscore; a character above U+FFFF two of them (it is two
    UTF-16 units).  Model tokens and newlines already in the text stay.  For single tokens; ``spell_texts`` is for whole files."""
    def one(text: Column) -> Column:
        other = F.regexp_replace(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", SUBSTITUTE * 2),
                                 f"[^ -~\n{ALPHABET[0]}-{ALPHABET[-1]}]", SUBSTITUTE)
        plain = F.translate(F.when(_is_ascii(text), text).otherwise(other), PRINTABLE, _LETTERS)
        # A model token has two bytes more than a character of ASCII: what follows the first one here is ASCII.
        led = F.ascii(text).between(PUA_START, PUA_START + BASE_SIZE - 1) & (F.octet_length(text) == F.length(text) + 2)
        substitutes = id_char(ID_OF[SUBSTITUTE]) * len(_CONTROL)
        return F.when(led & (F.instr(text, "\0") == 0), F.translate(text, PRINTABLE + _CONTROL, _LETTERS + substitutes)).otherwise(plain)
    return once(text, one)


_SPELLED = np.full(0x10001, ord(id_char(ID_OF[SUBSTITUTE])), np.uint16)        # by code point; the last entry is for higher ones
_SPELLED[[ord(c) for c in PRINTABLE]] = [ord(c) for c in _LETTERS]
_SPELLED[[ord(c) for c in ALPHABET]] = [ord(c) for c in ALPHABET]
_SPELLED[ord("\n")] = ord("\n")


def runs_of_texts(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Texts in runs of about ``RUN`` bytes: the bytes, and where each text begins and the last one ends.  Null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first = 0
    while first + 1 < len(offsets):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN, "right")) - 1)
        own = offsets[first:last + 1]
        yield (data.slice(int(own[0]), int(own[-1] - own[0])).to_pybytes() if own[-1] > own[0] else b""), own - own[0]
        first = last


def characters_before(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """How many characters of UTF-8 stand before each offset."""
    leads = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, dtype=np.int64)
    return np.r_[0, leads][offsets]


def _spelled_run(data: bytes, offsets: np.ndarray) -> pa.Array:
    codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.int32)
    at = characters_before(data, offsets)
    out = _SPELLED[np.minimum(codes, 0x10000)]
    control = np.flatnonzero(((codes < 32) & (codes != 10)) | (codes == 127))
    if len(control):                                                   # they stay in texts of ASCII alone
        row = np.searchsorted(at, control, "right") - 1
        own = np.diff(at)[row] == np.diff(offsets)[row]
        out[control[own]] = codes[control[own]]
    high = codes > 0xFFFF
    if high.any():
        ends = np.r_[0, np.cumsum(1 + high)]
        out, at = np.repeat(out, 1 + high), ends[at]
    text = out.tobytes().decode("utf-16-le").encode("utf-8")
    sizes = np.r_[0, np.cumsum(np.where(out < 128, 1, 3), dtype=np.int64)]
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(sizes[at]), pa.py_buffer(text))


def _by_runs(columns: Iterator[pa.Array], run: Callable[[bytes, np.ndarray], pa.Array]) -> Iterator[pa.Array]:
    """A function of many texts over columns; null stays null."""
    for column in columns:
        parts = [run(*texts) for texts in runs_of_texts(column)]
        made = pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())
        if column.null_count:
            made = pc.if_else(column.is_valid(), made, pa.scalar(None, pa.large_string()))
        yield made.cast(pa.string())


def _spelled_columns(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _by_runs(columns, _spelled_run)


def spell_texts(text: Column) -> Column:
    """The same as ``spell``, many texts at a time."""
    return F.arrow_udf(_spelled_columns, "string")(text)


def without_model_tokens(content: Column) -> Column:
    """Source text may hold private-use characters itself; they are letters outside ASCII like any other."""
    def one(text: Column) -> Column:
        return F.when(_is_ascii(text), text).otherwise(F.regexp_replace(text, f"[{ALPHABET[0]}-{ALPHABET[-1]}]", "\ufffd"))
    return once(content, one)


def mark_identifier(word: Column, mark_single_char: bool = False) -> Column:
    """Marker and the word, to be spelled later.  A one-letter ASCII name equals a character key and so gets no
    marker, unless ``mark_single_char`` asks for one."""
    marked = F.concat(F.lit(MARKER), word)
    if mark_single_char:
        return marked
    return F.when((F.length(word) == 1) & (F.ascii(word) < 128), word).otherwise(marked)


def encode_identifier(word: Column, mark_single_char: bool = False) -> Column:
    return spell_texts(mark_identifier(without_model_tokens(word), mark_single_char))


def _unspelled(token: Column, mark_single_char: bool) -> Column:
    lookup = lambda table: lx._lookup(table, token)
    words = {w: _type_char(t) for w, t in lx.WORD_TYPES.items()} | {"true": id_char(TRUE_ID), "false": id_char(FALSE_ID)}
    symbols = {s: _type_char(t) for s, t in lx.SYMBOL_TYPES.items()}
    by_type = F.array(F.lit(""), *(F.lit(_type_char(i)) for i in range(1, len(lx.TOKEN_TYPES) + 1)))
    newlines = F.replace(F.regexp_replace(token, r"[^\n]+", ""), F.lit("\n"), F.lit(EOL + "\n"))
    return lx.by_class(
        token,
        space=F.when(F.instr(token, "\n") > 0, newlines).otherwise(F.lit("")),
        word=F.when(token.isin(*words), lookup(words)).otherwise(mark_identifier(token, mark_single_char)),
        number=F.element_at(by_type, lx.number_type(token) + 1),
        quoted=F.element_at(by_type, lx.quoted_type(token) + 1),
        comment=F.lit(""),
        symbol=F.coalesce(lookup(symbols), F.lit("")))


def encode_token(token: Column, mark_single_char: bool = False) -> Column:
    """The encoded form of one token text: empty for comments, errors and blanks without a newline."""
    return spell(unspelled(token, mark_single_char))


def unspelled(token: Column, mark_single_char: bool = False) -> Column:
    """The encoded form before its spelling; empty for the same tokens."""
    return once(without_model_tokens(token), lambda t: _unspelled(t, mark_single_char))


def encode(content: Column, mark_single_char: bool = False) -> Column:
    """Token by token, the spelling of all names in one go at the end."""
    tokens = lx.lex_after_blanks(without_model_tokens(content))        # blanks without a newline have no code
    return spell_texts(F.array_join(F.transform(tokens, lambda t: _unspelled(t, mark_single_char)), ""))


def encode_file(content: Column, mark_single_char: bool = False) -> Column:
    """Encode a file as the batch job does: stripped non-empty lines first."""
    return encode(tx.compact_text(content), mark_single_char)


# --- Ids and characters ---------------------------------------------------------------------------------------
def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _known_ids(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the characters inside the alphabet, and how many of them stand before each offset."""
    codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.int32)
    known = (codes >= PUA_START) & (codes < PUA_START + BASE_SIZE)
    return codes[known] - PUA_START, np.r_[0, np.cumsum(known)][characters_before(data, offsets)]


def _id_columns(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        parts = []
        for texts in runs_of_texts(column):
            token, before = _known_ids(*texts)
            parts.append(pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(token.astype(np.int16))))
        made = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int16()))
        yield pc.if_else(column.is_valid(), made, pa.scalar(None, made.type)) if column.null_count else made


def to_ids(encoded: Column) -> Column:
    """array<smallint>: ids of the characters inside the alphabet; others (newlines too) are dropped."""
    return F.arrow_udf(_id_columns, "array<smallint>")(encoded)


def _chars_by_id() -> Column:
    return F.array(*(F.lit(c) for c in ALPHABET))


def from_ids(ids: Column) -> Column:
    """String of model tokens; an id outside the vocabulary fails the job."""
    def one(i: Column) -> Column:
        known = F.try_element_at(_chars_by_id(), i.cast("int") + 1)
        return F.when(i.between(0, BASE_SIZE - 1), known).otherwise(
            F.raise_error(F.concat(F.lit("unknown token id "), F.coalesce(i.cast("string"), F.lit("?")))))

    return F.array_join(F.transform(ids, one), "")


def id_line_to_chars(line: Column) -> Column:
    """``'225 52'`` to two characters; a blank line gives an empty text."""
    ids = F.filter(F.split(line, f"[{tx.UNICODE_SPACE}]+"), lambda x: x != "")
    return from_ids(F.transform(ids, lambda x: F.when(x.rlike("^(0|[1-9][0-9]{0,3})$"), x.cast("int"))))


def _decimal_table(first: int, last: int, line_ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in decimal with what stands after them, a row each, and which places of a row are used."""
    shown = [str(i).encode() + (b"\n" if line_ends and i == EOL_ID else b" ") for i in range(first, last + 1)]
    width = max(map(len, shown))
    table = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in shown), np.uint8).reshape(-1, width)
    return table, table != 0


def _decimal_texts(numbers: np.ndarray, before: np.ndarray, table: np.ndarray, used: np.ndarray) -> pa.Array:
    """Texts of numbers; ``before`` is how many stand before each text and the end.  After the last one stands nothing."""
    place = used[numbers]
    ends = np.r_[0, np.cumsum(place.sum(axis=1), dtype=np.int64)]
    some = np.diff(before) > 0
    last = before[1:][some] - 1
    place[last, ends[last + 1] - ends[last] - 1] = False
    at = ends[before] - np.r_[0, np.cumsum(some)]
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(table[numbers][place].tobytes()))


def _decimal_run(data: bytes, offsets: np.ndarray) -> pa.Array:
    return _decimal_texts(*_known_ids(data, offsets), *_ID_TEXTS)


_ID_TEXTS = _decimal_table(0, BASE_SIZE - 1, False)


def _decimal_columns(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _by_runs(columns, _decimal_run)


def char_line_to_ids(line: Column) -> Column:
    """Characters to ``'225 52'``; characters outside the alphabet are dropped."""
    return F.arrow_udf(_decimal_columns, "string")(line)


def _short_columns(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        ids = column.flatten().to_numpy(zero_copy_only=False).astype(">i2")
        ends = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)]
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends * 2), pa.py_buffer(ids.tobytes())])
        yield (pc.if_else(column.is_valid(), made, pa.scalar(None, made.type)) if column.null_count else made).cast(pa.binary())


def ids_to_shorts(ids: Column) -> Column:
    """Ids as big-endian 16-bit records."""
    return F.arrow_udf(_short_columns, "binary")(ids.cast("array<smallint>"))


def _id_text_columns(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A file at a time: its records are read in place."""
    table, used = _decimal_table(-32768, 32767, True)
    for column in columns:
        texts = []
        for data in column:
            if data.is_valid:
                size = len(data.as_buffer()) // 2                          # a stray last byte has no id
                numbers = np.frombuffer(data.as_buffer(), ">i2", size).astype(np.int64) + 32768
                run = [_decimal_texts(numbers[i:i + RUN], np.array([0, len(numbers[i:i + RUN])]), table, used)[0].as_py() for i in range(0, size, RUN)]
                joints = ["\n" if numbers[i - 1] - 32768 == EOL_ID else " " for i in range(RUN, size, RUN)]
                texts.append("".join(t + j for t, j in zip(run, [*joints, ""])))
            else:
                texts.append(None)
        yield pa.array(texts, pa.string())


def shorts_to_id_text(data: Column) -> Column:
    """Big-endian 16-bit ids to text, a newline after id 0, a space after the others, stripped."""
    return F.arrow_udf(_id_text_columns, "string")(data)


# --- Decoding ---------------------------------------------------------------------------------------------------
_END_OF_NAME, _INVALID = "\x01", "\x02"


def _spoken(token_id: int, value: str) -> str:
    numbers = "DECIMAL HEX OCT BINARY FLOAT HEX_FLOAT".split()
    placeholders = {ID_OF[f"!LEX_{n}_LITERAL"]: "0" for n in numbers}
    placeholders |= {ID_OF["!LEX_CHAR_LITERAL"]: "'x'", ID_OF["!LEX_STRING_LITERAL"]: '""', ID_OF["!LEX_TEXT_BLOCK"]: '""'}
    return placeholders.get(token_id, value) + " "


def decode(encoded: Column) -> Column:
    """Model tokens back to readable code.

    A marker and the characters after it form a name; a name is followed by a space unless the line or the text
    ends there or an invalid token follows.  Every other token is followed by a space.
    """
    one_unit = F.regexp_replace(F.replace(encoded, F.lit("\n"), F.lit("")), r"[\x{10000}-\x{10FFFF}]", _INVALID * 2)
    pieces = F.regexp_extract_all(one_unit, F.lit(f"{MARKER}[{_LETTERS[0]}-{_LETTERS[-1]}]*|[\\s\\S]"), F.lit(0))
    spoken = {id_char(i): _spoken(i, v) for i, _, v in BASE_VOCABULARY if i not in (EOL_ID, IDENTIFIER_ID)}

    def one(piece: Column) -> Column:
        name = F.concat(F.translate(F.substr(piece, F.lit(2)), _LETTERS, PRINTABLE), F.lit(_END_OF_NAME))
        return (F.when(piece.startswith(MARKER), name)
                .when(piece == EOL, "\n")
                .otherwise(F.coalesce(lx._lookup(spoken, piece), F.lit(_INVALID))))

    joined = F.array_join(F.transform(pieces, one), "")
    unspaced = F.regexp_replace(joined, f"{_END_OF_NAME}(?=[\n{_INVALID}]|\\z)", "")
    shown = F.replace(F.replace(unspaced, F.lit(_END_OF_NAME), F.lit(" ")), F.lit(_INVALID), F.lit("<?>"))
    return tx.trim_control(shown)


def decode_id_text(id_text: Column) -> Column:
    """Decode decimal ids separated by spaces and newlines; anything that is no known id shows as ``<?>``."""
    words = F.filter(F.split(tx.trim_control(id_text), "[ \n]+"), lambda x: x != "")

    def one(word: Column) -> Column:
        value = F.when(word.rlike(r"\A[+-]?[0-9]+\z"), word.try_cast("int"))
        return F.when(value.between(0, BASE_SIZE - 1), F.element_at(_chars_by_id(), value + 1)).otherwise(F.lit(_INVALID))

    return decode(F.array_join(F.transform(words, one), ""))


def cut_at_line_end(encoded: Column) -> Column:
    """The text up to its first end-of-line token, which is put back (or added)."""
    return F.concat(F.substring_index(encoded, EOL, 1), F.lit(EOL))
