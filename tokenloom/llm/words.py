"""Words of whole texts as 64-bit hashes, computed on the bytes of an Arrow column.

Upper-case A-Z count as lower-case.  Texts are taken in slices of about a megabyte; a longer text is cut between two
words, so the memory used does not depend on the longest text (only on its number of words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20


def space_words() -> np.ndarray:
    """Bytes of ``[^\\x20\\x09-\\x0D]+``, after lower-casing."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def letter_words() -> np.ndarray:
    """Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, after lower-casing: digits, a-z, everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose high bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes words with a polynomial of their bytes; holds the powers, a few megabytes for each task."""

    def __init__(self, inside: np.ndarray):
        lower = np.arange(256)
        lower[65:91] += 32
        self.inside = inside[lower]
        self.value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[lower]
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        base = 0xD6E8FEB86659FD93
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)])
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(base, -1, 1 << 64), np.uint64)])

    def piece(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words; no word crosses a cut."""
        if len(data) >= len(self.power):
            self._grow(max(2 * SLICE, len(data)))
        inside = self.inside[data]
        previous = np.r_[False, inside[:-1]]
        previous[cuts[cuts < len(data)]] = False
        following = np.r_[inside[1:], False]
        following[cuts[cuts > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~previous), np.flatnonzero(inside & ~following) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[:len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
        return starts, ends, mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def long_text(self, data: np.ndarray) -> np.ndarray:
        parts, at = [], 0
        while at < len(data):
            end, size = len(data), SLICE
            while at + size < len(data):
                gaps = np.flatnonzero(~self.inside[data[at:at + size]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                    break
                size *= 2
            parts.append(self.piece(data[at:end], np.zeros(1, np.int64))[2])
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts and the last one ends; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def row_runs(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, end) of about ``size`` bytes, at least one row each."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first, held = 0, 0
    for row, length in enumerate(lengths):
        held += length
        if held >= size:
            yield first, row + 1
            first, held = row + 1, 0
    if first < len(lengths):
        yield first, len(lengths)


def hashed_words(hasher: WordHasher, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of rows: the first row, the hashes of all words, and the first word of each row with the end of the last."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        cuts = offsets[row:last + 1] - offsets[row]
        piece = data[offsets[row]:offsets[last]]
        if len(piece) > SLICE and last == row + 1:
            hashes = hasher.long_text(piece)
            yield row, hashes, np.array([0, len(hashes)])
        else:
            starts, _, hashes = hasher.piece(piece, cuts)
            yield row, hashes, np.searchsorted(starts, cuts)
        row = last


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, size * 0x8CB92BA72F3D8DD7 % (1 << 64), np.uint64)
    for j in range(size):
        total = total * np.uint64(0x9FB21C651E98DF25) + hashes[j:j + count]
    return mixed(total)
