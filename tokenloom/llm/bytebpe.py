"""Byte-level BPE encoding and decoding (11) by a sentencepiece model made from the vocabulary.

A vocabulary is a rank file: byte strings and their ranks, which are their ids.  It is written as a sentencepiece model of
the BPE kind: every byte has a printable letter (``byte_letters``), a piece is its bytes' letters and scores its negative
rank, and normalisation is the identity, so sentencepiece joins the neighbours of lowest rank first, the leftmost among
equals, as the rank file asks.  Texts are cut by the pattern, each match is encoded on its own, and a match that is
a piece itself has that id even where joins don't lead to it.  Decoding is the inverse mapping: ids to letters to bytes.

The model is a broadcast, its size checked (``MODEL_BYTES``).  Tasks cut a text ``CUTS`` matches at a time and remember the ids
of short matches, up to ``REMEMBERED`` of them; both bound memory and change no result.

Defined cases: null text counts as empty and gives no ids; bytes that are no UTF-8 count as U+FFFD; long texts and long
matches are encoded whole; strings of special tokens are ordinary text; no ids decode to no bytes, and null ids to null; an id
that the vocabulary lacks is an error; repeated rows are rows of their own; columns other than id and text are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

MODEL_BYTES = 1 << 26         # a larger model is an error; 50,000 pieces take 1 MB
CUTS = 1 << 16                # matches of a text that are held at a time
REMEMBERED, SHORT = 1 << 18, 48      # matches that a task remembers, and their characters
FLUSH = 1 << 20               # ids or bytes of an output batch

# --- Fixed values: field numbers and kinds of the public model format --------------------------------------------
MODEL_PIECES, MODEL_TRAINER, MODEL_NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
TRAINER_KIND, TRAINER_BYTE_FALLBACK, BPE = 3, 35, 2
NORMALIZER_NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5
NORMAL, UNKNOWN = 1, 2
# ------------------------------------------------------------------------------------------------------------------


def byte_letters() -> list[str]:
    """A printable letter for each byte: Latin-1 where it is printable, else the next free one from U+0100 on."""
    printable = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _entry(number: int, value: int | float | bytes) -> bytes:
    """One field of a message: a number, a 32-bit float, or bytes with their length."""
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    return _number(number << 3) + _number(value)


def piece_model(pieces: list[bytes], ranks: list[int]) -> bytes:
    """The serialised model; a piece's number is its place, and the unknown piece comes last."""
    letters = byte_letters()
    out = []
    for piece, rank in zip(pieces, ranks):
        text = "".join(letters[b] for b in piece).encode()
        out.append(_entry(MODEL_PIECES, _entry(PIECE_TEXT, text) + _entry(PIECE_SCORE, -float(rank)) + _entry(PIECE_KIND, NORMAL)))
    out.append(_entry(MODEL_PIECES, _entry(PIECE_TEXT, b"<unk>") + _entry(PIECE_SCORE, 0.0) + _entry(PIECE_KIND, UNKNOWN)))
    out.append(_entry(MODEL_TRAINER, _entry(TRAINER_KIND, BPE) + _entry(TRAINER_BYTE_FALLBACK, 0)))
    out.append(_entry(MODEL_NORMALIZER, _entry(NORMALIZER_NAME, b"identity") + _entry(ADD_DUMMY_PREFIX, 0)
                      + _entry(REMOVE_EXTRA_SPACES, 0) + _entry(ESCAPE_SPACES, 0)))
    model = b"".join(out)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model takes more than {MODEL_BYTES} bytes")
    return model


@dataclass
class Vocabulary:
    """What tasks need: the model, the id of each piece, the pattern, and pieces that joins don't lead to."""

    model: bytes
    ids: list[int]
    pattern: str
    whole: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        """Ranks must be distinct, below 2^24 so that a score is exact, and include every single byte."""
        pieces = sorted(ranks, key=ranks.__getitem__)
        ids = [ranks[p] for p in pieces]
        if len(set(ids)) < len(ids) or not ids or ids[0] < 0 or ids[-1] >= 1 << 24:
            raise ValueError("ranks must be distinct numbers from 0 to 2^24")
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        out = cls(piece_model(pieces, ids), ids, pattern)
        coder = Coder(out)
        written = [coder.letters_of(p) for p in pieces]
        joined = coder.model.encode(written, num_threads=1)
        out.whole = {text: i for i, (text, found) in zip(ids, zip(written, joined)) if len(found) != 1}
        return out

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A rank file of the driver: a line is a piece in base64, a space and its rank."""
        with open(path, "rb") as lines:
            return cls.of_ranks({base64.b64decode(p): int(r) for p, r in map(bytes.split, lines)}, pattern)


class Coder:
    """Encodes and decodes within a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.model = SentencePieceProcessor(model_proto=vocabulary.model)
        self._pattern, self._whole = regex.compile(vocabulary.pattern), vocabulary.whole
        self._ids = vocabulary.ids
        self._plain = vocabulary.ids == list(range(len(vocabulary.ids)))
        self._letters = dict(enumerate(byte_letters()))
        self._seen: dict[str, list[int]] = {}

    def letters_of(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self._letters)

    def _learn(self, cuts: set[str]) -> dict[str, bytes]:
        """The ids of each match, as 32-bit numbers one after the other."""
        order = list(cuts)
        written = [self.letters_of(x.encode()) for x in order]
        found = self.model.encode(written, num_threads=1)
        if not self._plain:
            found = [[self._ids[i] for i in own] for own in found]
        if self._whole:
            found = [[self._whole[w]] if w in self._whole else own for w, own in zip(written, found)]
        return {x: array("i", own).tobytes() for x, own in zip(order, found)}

    def _cuts(self, text: str) -> Iterator[list[str]]:
        if len(text) <= CUTS:
            yield self._pattern.findall(text)
            return
        matches = self._pattern.finditer(text)
        while cuts := [m[0] for m in islice(matches, CUTS)]:
            yield cuts

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit numbers."""
        out = []
        for cuts in self._cuts(text):
            distinct = set(cuts)
            new = distinct.difference(self._seen)
            if len(self._seen) + len(new) > REMEMBERED:
                new, self._seen = distinct, {}
            self._seen.update(self._learn(new))
            out.append(b"".join(map(self._seen.__getitem__, cuts)))
            for x in [x for x in new if len(x) > SHORT]:
                del self._seen[x]
        return b"".join(out)

    def bytes_of_ids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each id the place and number of its bytes (-1 where there is none), and all bytes, from the model's pieces."""
        raw_of = {letter: byte for byte, letter in self._letters.items()}
        raw = [bytes(raw_of[c] for c in self.model.id_to_piece(i)) for i in range(len(self._ids))]
        start, size = np.zeros(self._ids[-1] + 1, np.int64), np.full(self._ids[-1] + 1, -1, np.int64)
        lengths = np.array([len(r) for r in raw], np.int64)
        start[self._ids], size[self._ids] = np.cumsum(lengths) - lengths, lengths
        return start, size, np.frombuffer(b"".join(raw), np.uint8)


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``FLUSH`` together."""
    first, held = 0, 0
    for row, size in enumerate(sizes):
        held += size
        if held >= FLUSH:
            yield first, row + 1
            first, held = row + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def _encode(shared):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for a, b in _runs(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                texts = [(raw or b"").decode("utf-8", "replace") for raw in batch.column(1).slice(a, b - a).to_pylist()]
                ids = [coder.encode(text) for text in texts]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), values)], ["_id", "ids"])
    return encode


def _decode(shared):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, size, raw = Coder(shared.value).bytes_of_ids()
        for batch in batches:
            lists = batch.column(1)
            for a, b in _runs(lists.value_lengths().fill_null(0).to_pylist()):
                own = lists.slice(a, b - a)
                ids = own.flatten()
                if ids.null_count:
                    raise ValueError("an id is null")
                ids = ids.to_numpy().astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or size[ids].min() < 0):
                    raise ValueError("an id is not in the vocabulary")
                ends = np.cumsum(np.r_[0, size[ids]])
                place = np.repeat(start[ids] - ends[:-1], size[ids]) + np.arange(ends[-1])
                rows = np.cumsum(np.r_[0, own.value_lengths().fill_null(0).to_numpy()])
                text = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends[rows].astype(np.int32)), pa.py_buffer(raw[place])])
                if own.null_count:
                    text = pa.array([x if valid else None for x, valid in zip(text.to_pylist(), own.is_valid().to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), own, text], ["_id", "ids", "bytes"])
    return decode


def encoded(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """One row per document: ``_id`` and ``ids``."""
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_encode(spark.sparkContext.broadcast(vocabulary)), f"_id {kind}, ids array<int>")


def decoded(spark: SparkSession, rows: DataFrame, vocabulary: Vocabulary, id_column: str = "_id", ids_column: str = "ids") -> DataFrame:
    """``_id``, ``ids`` and the ``bytes`` that they stand for."""
    own = rows.select(F.col(id_column).alias("_id"), F.col(ids_column).cast("array<int>").alias("ids"))
    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInArrow(_decode(spark.sparkContext.broadcast(vocabulary)), f"_id {kind}, ids array<int>, bytes binary")


def report(rows: DataFrame) -> DataFrame:
    """Digests of the ids and of the decoded bytes."""
    joined = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return rows.select(F.col("_id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
