"""Byte-pair vocabulary learned exactly on distributed lines, and its application.

Training goes in phases.  A pair that stands at a place now is at least as frequent as any pair that merges will make there,
so a place whose pair is rarer than ``least`` takes no part in a merge of that count or more: a phase cuts the words at
these places and works on the distinct fragments, which are much less than the corpus.  When no pair of that count is
left, its merges are applied to the words and the next phase begins with a smaller ``least``.  A merge that gives an old id ends
a phase, since then places with unlike pairs may meet in one.  Where too many pairs are equally frequent nothing is cut.

The state of a phase is a table of blocks of fragments (ids, ends, counts) in parts, and a ranking of adjacent pairs in the
driver.  The ranking is an inverted index: with a pair's count it knows the parts that may hold it, and both are kept
current from the changes.  A round guesses the next merges from the ranking and from what they would change in a bounded draw of
fragments in the driver, and reads the parts that hold one of them; there each merge costs as much as it has places, and what it adds to and takes from the pair counts comes back step by step.
The driver replays the steps: a guess stands as long as the counts, after all steps before it, have it in the first place.
So the result is that of one merge after another, for any guesses.

The driver holds the ``HELD`` best pairs.  Counts of old pairs never grow and new pairs come with their whole count, so
what is left in the table can win only when all that is held ranks behind it; then the pairs are counted again.

For application merges are applied in rank order to many words at a time.  A symbol is one code point, U+F0000 + id.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import codec as cd
from tokenloom.session import Tables, small_batches

# --- Fixed values ---------------------------------------------------------------------------------------------
SPECIAL_TOKENS = ("<UNK>", "<PAD>")
UNKNOWN_ID, PAD_ID = 0, 1
TARGET_SIZE = 16384
MIN_FREQUENCY = 2
# ---------------------------------------------------------------------------------------------------------------
SYMBOL_START = 0xF0000
MAX_SYMBOLS = 0x10FFFF - SYMBOL_START + 1
HELD = 1 << 18             # pairs in the driver while training; all others stay in a table
PARTS = 256                # most parts of the words while training, a bit each in the index
PART = 1 << 19             # characters of a part, up to that number of parts
GUESSES = 48               # most merges of a round; fewer after rounds in which few stood
PREVIEW = 1 << 19          # symbols in the driver by which merges are guessed, of frequent fragments and of others
BLOCK = 1 << 19            # symbols that are merged at a time
TEXTS = 64                 # strings of a column that are made at a time
GRID = 1 << 20             # places of a grid of pairs by both ids; larger sets of pairs are searched
PHASE = 8                  # a phase makes the merges of pairs at least this part as frequent as its first


def symbol(token_id: int) -> str:
    return chr(SYMBOL_START + token_id)


@dataclass
class Round:
    """What a round of training did: merges that stood, parts and bytes that it read."""

    merges: int
    parts: int
    bytes: int


@dataclass
class BpeModel:
    """Vocabulary in id order and merges in rank order; at most ``MAX_SYMBOLS`` entries, so safe to ship."""

    tokens: list[str]
    merges: list[tuple[int, int, int]] = field(default_factory=list)
    rounds: list[Round] = field(default_factory=list, compare=False)      # of training, in order

    @property
    def alphabet(self) -> list[str]:
        return [t for t in self.tokens[len(SPECIAL_TOKENS):] if len(t) == 1]

    @property
    def reuses_ids(self) -> bool:
        """True if some merge produced a string that already had an id: ranks then say nothing about order."""
        new = [m[2] for m in self.merges]
        return any(a >= b for a, b in zip(new, new[1:]))

    def first(self, size: int) -> BpeModel:
        """The model as it was when it had ``size`` entries."""
        merges = []
        for merge in self.merges:
            if merge[2] >= size:
                break
            merges.append(merge)
        return BpeModel(self.tokens[:size], merges)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), "bpe_id int, token string")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(rank, *merge, self.tokens[merge[2]]) for rank, merge in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left_id int, right_id int, new_id int, token string")

    @classmethod
    def from_tables(cls, vocabulary: DataFrame, merges: DataFrame) -> BpeModel:
        """Fails for a table that is longer than symbol ids allow; it is never cut."""
        tokens = [r.token for r in vocabulary.orderBy("bpe_id").limit(MAX_SYMBOLS + 1).collect()]
        rows = merges.orderBy("rank").limit(MAX_SYMBOLS + 1).collect()
        if max(len(tokens), len(rows)) > MAX_SYMBOLS:
            raise ValueError(f"at most {MAX_SYMBOLS} entries fit the symbol range")
        return cls(tokens, [(r.left_id, r.right_id, r.new_id) for r in rows])


# --- Tables -----------------------------------------------------------------------------------------------------
def word_counts(lines: DataFrame, column: str = "unicode") -> DataFrame:
    """(word, n): distinct non-empty stripped lines.  Counted within each task first."""
    from tokenloom.functions.text import strip
    stripped = strip(F.col(column))
    return lines.select(stripped.alias("word")).where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("n"))


def words_of(lines: DataFrame, column: str = "unicode") -> DataFrame:
    """(word, n): the same words, a row for each place; for work that costs less than bringing equal lines together."""
    from tokenloom.functions.text import strip
    return lines.select(strip(F.col(column)).alias("word"), F.lit(1).cast("bigint").alias("n")).where(F.col("word") != "")


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, cnt): neighbouring characters weighted by how often their word occurs; overlaps count."""
    counted = words.select("word", F.col("n").cast("bigint").alias("n"))
    return counted.mapInArrow(_pairs_of_words, "pair string, cnt bigint").groupBy("pair").agg(F.sum("cnt").alias("cnt"))


def _pairs_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each run of words, a row each."""
    for batch in batches:
        counts, at = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), 0
        for own in _runs(batch.column(0).to_pylist()):
            letters = sorted(set().union(*map(set, own)))
            start = len(SPECIAL_TOKENS)
            pairs, totals = _pair_totals(Letters(letters).ids(own), counts[at:at + len(own)])
            at += len(own)
            shown = [letters[(pair >> 32) - start] + letters[(pair & 0xFFFFFFFF) - start] for pair in pairs.tolist()]
            yield pa.record_batch({"pair": pa.array(shown, pa.string()), "cnt": pa.array(totals)})


def frequent(pairs: DataFrame, min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    return pairs.where(F.col("cnt") >= min_frequency)


def best_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The n best pairs: count descending, then left and right id ascending (code point order of the pair)."""
    return pairs.orderBy(F.col("cnt").desc(), "pair").limit(n)


def alphabet_of(letters: Sequence[str]) -> list[str]:
    """The letters in code point order; fails beyond what ids can hold."""
    letters = sorted(set(letters))
    if len(letters) + len(SPECIAL_TOKENS) >= MAX_SYMBOLS or (letters and ord(letters[-1]) >= SYMBOL_START):
        raise ValueError("the corpus has more characters, or higher ones, than symbol ids can hold")
    return letters


# --- Merging ----------------------------------------------------------------------------------------------------
GAP, DEAD = -1, -2         # stand after a word, and where a symbol went into the one before it
Merge = tuple[int, int, int]


class PairTable:
    """Numbers of pairs, found by both ids; the first of equal pairs counts."""

    def __init__(self, merges: Sequence[Merge]):
        numbers = {left << 32 | right: number for number, (left, right, _) in reversed(list(enumerate(merges)))}
        codes = np.array(sorted(numbers), np.int64)
        self.codes, self.numbers = codes, np.array([numbers[c] for c in codes.tolist()], np.int64)
        self.most = most = max((max(m) for m in merges), default=0)
        lefts, rows = np.unique(codes >> 32, return_inverse=True)
        rights, columns = np.unique(codes & 0xFFFFFFFF, return_inverse=True)
        self._grid = None
        if (len(lefts) + 1) * (len(rights) + 1) <= GRID:                # row and column 0 are for all other ids; GAP and DEAD index the last two
            width = len(rights) + 1
            self._row, self._column = np.zeros(most + 3, np.int32), np.zeros(most + 3, np.int32)
            self._row[lefts], self._column[rights] = np.arange(1, width * len(lefts) + 1, width) + width - 1, np.arange(1, width)
            self._grid = np.full((len(lefts) + 1) * width, -1, np.int16 if len(merges) < 1 << 15 else np.int32)
            self._grid[(rows + 1) * width + columns + 1] = self.numbers
        else:
            self._is_left, self._is_right = np.zeros(most + 3, bool), np.zeros(most + 3, bool)
            self._is_left[lefts] = self._is_right[rights] = True

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are in the table, and their numbers."""
        if not len(self.codes):
            return np.zeros(0, np.int64), self.numbers
        left, right = np.minimum(left, self.most + 1), np.minimum(right, self.most + 1)     # the one above all ids is in no pair
        if self._grid is not None:
            numbers = self._grid[self._row[left] + self._column[right]]
            found = np.flatnonzero(numbers >= 0)
            return found, numbers[found]
        may = np.flatnonzero(self._is_left[left] & self._is_right[right])
        codes = (left[may].astype(np.int64) << 32) | right[may]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        found = self.codes[at] == codes
        return may[found], self.numbers[at[found]]


class Chain:
    """Words of ids, a gap after each, as a linked list: a merge visits only its own places."""

    def __init__(self, ids: np.ndarray, table: PairTable):
        self.ids = ids.astype(np.int32)
        self.next = np.arange(1, len(ids) + 1, dtype=np.int32)
        self.before = np.arange(-1, len(ids) - 1, dtype=np.int32)      # -1, before the first, is the last gap
        self.word = np.cumsum(np.r_[0, ids[:-1] == GAP], dtype=np.int32) if len(ids) else np.zeros(0, np.int32)
        self._table, self._places = table, {}
        self.waiting: list[int] = []                                   # numbers of pairs that have places, smallest first
        if len(ids) > 1:
            self._note(np.arange(len(ids) - 1, dtype=np.int32), self.ids[:-1], self.ids[1:])

    def _note(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        found, numbers = self._table.find(left, right)
        if len(found):
            order = np.argsort(numbers, kind="stable")
            numbers, at = numbers[order], at[found[order]]
            first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
            for number, own in zip(numbers[first].tolist(), np.split(at, first[1:])):
                self._put(number, own)

    def _put(self, number: int, at: np.ndarray) -> None:
        held = self._places.setdefault(number, [])
        if not held:
            heapq.heappush(self.waiting, number)
        held.append(at)

    def merge(self, number: int, merge: Merge, changes: list | None = None, one_per_word: bool = False) -> np.ndarray:
        """Replace the pair, leftmost first (with ``one_per_word`` the first in each word), and return its places.  ``changes``
        gets the pairs that went and came: where they begin, left, right (arrays or one id), sign."""
        left, right, new = merge
        held = self._places.pop(number, [])
        at = held[0] if len(held) == 1 else np.unique(np.concatenate(held)) if held else np.zeros(0, np.int32)
        at = at[self.ids[at] == left]
        follow = self.next[at]
        there = self.ids[follow] == right
        at, follow = at[there], follow[there]
        if left == right and len(at) > 1:                              # of a run of equal ids every other pair
            first = np.r_[True, follow[:-1] != at[1:]]
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            keep = (np.arange(len(at)) - run) % 2 == 0
            at, follow = at[keep], follow[keep]
        if one_per_word and len(at):
            first = np.r_[True, self.word[at[1:]] != self.word[at[:-1]]]
            if not first.all():
                self._put(number, at[~first])
            at, follow = at[first], follow[first]
        if not len(at):
            return at
        beyond, before = self.next[follow], self.before[at]
        apart = np.r_[True, before[1:] != follow[:-1]]                 # else the place before lies in the merge before
        before = before[apart]
        before = before[self.ids[before] >= 0]                         # -1 is the last gap
        led = self.ids[before]
        if changes is not None:
            changes.append((at, left, right, -1))
            changes.append((before, led, left, -1))
            inside = self.ids[beyond] >= 0
            changes.append((follow[inside], right, self.ids[beyond[inside]], -1))
        self.ids[at], self.ids[follow] = new, DEAD
        self.next[at], self.before[beyond] = beyond, at
        follows = self.ids[beyond]
        inside = follows >= 0
        place, follows = at[inside], follows[inside]
        if changes is not None:
            changes.append((before, led, new, 1))
            changes.append((place, new, follows, 1))
        self._note(before, led, np.full(len(led), new, np.int32))
        self._note(place, np.full(len(place), new, np.int32), follows)
        return at

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """All pairs, as changes."""
        at = np.flatnonzero(self.ids >= 0)
        right = self.ids[self.next[at]]
        at, right = at[right >= 0], right[right >= 0]
        return [(at, self.ids[at], right, 1)]

    def live(self) -> np.ndarray:
        return self.ids[self.ids != DEAD]


def flat_ids(words: list[str]) -> np.ndarray:
    """Ids of words of symbols, a gap after each; what is no symbol is unknown."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32).astype(np.int64) - SYMBOL_START
    ids = np.where(codes < 0, UNKNOWN_ID, codes).astype(np.int32)
    ids[np.cumsum(sizes + 1) - 1] = GAP
    return ids


class Letters:
    """Ids of characters by their code points; any other character is unknown."""

    def __init__(self, letters: Sequence[str]):
        codes = np.array([ord(c) for c in letters], np.int64)
        self._ids = np.full(int(codes.max(initial=0)) + 2, UNKNOWN_ID, np.int32)      # the last entry is for higher ones
        self._ids[codes] = np.arange(len(codes), dtype=np.int32) + len(SPECIAL_TOKENS)

    def ids(self, words: list[str]) -> np.ndarray:
        """Ids of words, a gap after each."""
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.int32)
        ids = self._ids[np.minimum(codes, len(self._ids) - 1)]
        ids[np.cumsum(sizes + 1) - 1] = GAP
        return ids


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The strings of a column, made a few at a time."""
    for first in range(0, len(column), TEXTS):
        yield from column.slice(first, TEXTS).to_pylist()


def _runs(words: Iterable[str | None]) -> Iterator[list[str]]:
    """Words in runs of about ``BLOCK`` symbols; null counts as empty."""
    run, held = [], 0
    for word in words:
        run.append(word or "")
        held += len(run[-1]) + 1
        if held >= BLOCK:
            yield run
            run, held = [], 0
    if run:
        yield run


# --- Training ---------------------------------------------------------------------------------------------------
class _Ranking:
    """Counts and parts of the pairs that the driver holds, best first: count descending, then left and right id.

    ``bound`` ranks before all pairs that it lacks (None: it lacks none).  Outdated heap entries are skipped.
    """

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.parts: dict[int, int] = {}
        self.bound: tuple[int, int] | None = None
        self._heap: list[tuple[int, int]] = []

    def load(self, pairs: DataFrame) -> None:
        """Hold the best of all pairs."""
        self.__init__()
        total = pairs.count()
        if total > HELD:                                # put in order only a little more than what is held
            level = F.floor(F.log(F.col("cnt").cast("double")) * 16)
            sizes = sorted(((r["level"], r["count"]) for r in pairs.groupBy(level.alias("level")).count().collect()), reverse=True)
            least, held = None, 0
            for least, size in sizes:
                held += size
                if held >= HELD:
                    break
            pairs = pairs.where(level >= least).orderBy(F.desc("cnt"), "left_id", "right_id").limit(HELD)
        self.add(pairs.toArrow())
        if total > HELD:
            self.bound = max((-n, code) for code, n in self.counts.items())

    def add(self, changes: pa.Table) -> None:
        """Changes of counts; a new pair that ranks behind the bound stays in the table."""
        code = (changes["left_id"].to_numpy().astype(np.int64) << 32) | changes["right_id"].to_numpy()
        masks = [changes[f"m{k}"].to_numpy().astype(np.uint64).tolist() for k in range(PARTS // 64)]
        for pair, change, *own in zip(code.tolist(), changes["cnt"].to_pylist(), *masks):
            count = self.counts.pop(pair, 0) + change
            if count > 0 and (self.bound is None or (-count, pair) <= self.bound):
                self.counts[pair] = count
                self.parts[pair] = self.parts.get(pair, 0) | sum(m << 64 * k for k, m in enumerate(own))
                heapq.heappush(self._heap, (-count, pair))
            else:
                self.parts.pop(pair, None)
        if len(self.counts) > 2 * HELD:
            kept = heapq.nsmallest(HELD, ((-n, pair) for pair, n in self.counts.items()))
            self.bound = kept[-1]
            self.counts = {pair: -n for n, pair in kept}
            self.parts = {pair: self.parts[pair] for _, pair in kept}
            self._heap = kept                                          # sorted, so it is a heap

    def head(self, n: int, min_frequency: int) -> list[int]:
        """The best pairs, at most n; none of the missing ones ranks before them."""
        out = []
        while self._heap and len(out) < n:
            entry = self._heap[0]
            if self.counts.get(entry[1]) != -entry[0] or (out and out[-1] == entry):
                heapq.heappop(self._heap)
            elif -entry[0] < min_frequency:
                break
            else:
                out.append(heapq.heappop(self._heap))
        for entry in out:
            heapq.heappush(self._heap, entry)
        return [pair for _, pair in out]


class _Preview:
    """Fragments in the driver that tell how counts will change, so that guesses go further.  The most frequent ones are all
    here and the others are drawn by a hash, each for as many as it stands for; guesses are checked on all, so a bad draw
    costs rounds and changes nothing."""

    def __init__(self, fragments: DataFrame, levels: dict[int, int]):
        """``levels``: symbols of the fragments by the bits of their count."""
        least, held = max(levels, default=0) + 1, 0
        for level in sorted(levels, reverse=True):
            if held + levels[level] > PREVIEW:
                break
            least, held = level, held + levels[level]
        share = max(1, -(-sum(size for level, size in levels.items() if level < least) // PREVIEW))
        common = _level() >= least
        drawn = fragments.where(common | (F.pmod(F.xxhash64("ids"), F.lit(share)) == 0))
        rows = drawn.select("ids", F.when(common, F.col("n")).otherwise(F.col("n") * share).alias("n")).toArrow()
        sizes = pc.binary_length(rows["ids"]).to_numpy().astype(np.int64) // 4
        self.ids = np.full(int(sizes.sum()) + len(sizes), GAP, np.int32)
        inside = np.ones(len(self.ids), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        self.ids[inside] = np.frombuffer(b"".join(rows["ids"].to_pylist()), ">i4")
        self.counts = np.repeat(rows["n"].to_numpy().astype(np.int64), sizes + 1)

    @staticmethod
    def _merged(ids: np.ndarray, counts: np.ndarray, merge: Merge) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """Symbols and counts after a merge, and about how the counts of other pairs change."""
        left, right, new = merge
        at = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right))
        if left == right and len(at) > 1:                              # of a run of equal ids every other pair
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        weights, changes = counts[at], {}
        before, beyond = np.where(at > 0, ids[at - 1], GAP), ids[np.minimum(at + 2, len(ids) - 1)]
        for other, led in ((before, True), (beyond, False)):
            inside = other >= 0
            total = np.bincount(other[inside], weights[inside])
            for one in np.flatnonzero(total).tolist():
                change = int(total[one])
                gone, come = (one << 32 | left, one << 32 | new) if led else (right << 32 | one, new << 32 | one)
                changes[gone] = changes.get(gone, 0) - change
                changes[come] = changes.get(come, 0) + change
        ids[at] = new
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        return ids[keep], counts[keep], changes

    def merge(self, merges: Sequence[Merge]) -> None:
        for merge in merges:
            self.ids, self.counts, _ = self._merged(self.ids, self.counts, merge)

    def expected(self, ranking: _Ranking, model: BpeModel, min_frequency: int, most: int) -> Iterator[int]:
        """The pairs that should be merged next; to be told the id that each of them gives."""
        ids, counts, shift = self.ids.copy(), self.counts, {}
        held = ranking.head(4 * most, min_frequency)
        while True:
            known = ((pair, ranking.counts[pair] + shift.get(pair, 0)) for pair in held)
            fresh = ((pair, n) for pair, n in shift.items() if n >= min_frequency and pair not in ranking.counts)
            count, pair = min(((-n, pair) for pair, n in (*known, *fresh)), default=(0, 0))
            if -count < min_frequency:
                return
            new = yield pair
            ids, counts, changes = self._merged(ids, counts, (pair >> 32, pair & 0xFFFFFFFF, new))
            for other, n in changes.items():
                shift[other] = shift.get(other, 0) + n
            shift[pair] = -(1 << 62)


def _guessed(ranking: _Ranking, model: BpeModel, known: dict[str, int], min_frequency: int, most: int, preview: _Preview) -> list[Merge]:
    """The next merges, the first one surely.  One that gives an old id is the last: pairs with it may grow."""
    batch: list[Merge] = []
    tokens, names = list(model.tokens), {}
    pairs = preview.expected(ranking, model, min_frequency, most)
    pair = next(pairs, None) if ranking.head(1, min_frequency) else None
    while pair is not None:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        text = tokens[left] + tokens[right]
        old = known.get(text, names.get(text))
        batch.append((left, right, len(tokens) if old is None else old))
        if old is not None or len(batch) == most:
            break
        names[text] = batch[-1][2]
        tokens.append(text)
        try:
            pair = pairs.send(batch[-1][2])
        except StopIteration:
            break
    return batch


def _level() -> Column:
    """The bits of a fragment's count."""
    return F.floor(F.log2(F.col("n").cast("double"))).cast("int")


BLOCK_TABLE = "part int, size bigint, ids binary, counts binary"
CHANGES = "step int, left_id int, right_id int, cnt bigint, part int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of big-endian ids as arrays of ids."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        counts, ends = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes + 1)
        first = 0
        while first < len(sizes):                               # none in an empty batch
            start = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + BLOCK, "right")))
            ids = np.full(ends[last - 1] - start, GAP, np.int32)
            inside = np.ones(len(ids), bool)
            inside[ends[first:last] - 1 - start] = False
            ids[inside] = np.frombuffer(b"".join(batch.column(0).slice(first, last - first).to_pylist()), ">i4")
            yield _block(batch.column(2)[0].as_py(), ids, counts[first:last])
            first = last


def _block(part: int, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"part": pa.array([part], pa.int32()), "size": pa.array([ids.nbytes + counts.nbytes], pa.int64()),
                            "ids": pa.array([ids.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _chains(batches: Iterator[pa.RecordBatch], merges: Sequence[Merge], done: int) -> Iterator[tuple[int, Chain, np.ndarray]]:
    """Part, words with the first ``done`` merges applied, and counts of each block."""
    table = PairTable(merges)
    number = {pair: n for pair, n in zip(table.codes.tolist(), table.numbers.tolist())}
    steps = [(number[left << 32 | right], (left, right, new)) for left, right, new in merges[:done]]
    for batch in batches:
        for part, ids, counts in zip(batch.column("part").to_pylist(), batch.column("ids"), batch.column("counts")):
            chain = Chain(np.frombuffer(ids.as_buffer(), np.int32), table)
            for step in steps:
                chain.merge(*step)
            yield part, chain, np.frombuffer(counts.as_buffer(), np.int64)


def changes_of(chain: Chain, counts: np.ndarray, number: int, merge: Merge) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs whose count a merge changes, and by how much."""
    found: list = []
    chain.merge(number, merge, found)
    return _summed(chain, counts, found)


def _summed(chain: Chain, counts: np.ndarray, changes: list) -> tuple[np.ndarray, np.ndarray]:
    """Changes by pair; where one side is a single id the other one is its bin."""
    codes, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, left, right, sign in changes:
        weights = sign * counts[chain.word[at]]
        if not len(at):
            continue
        if np.ndim(left) and np.ndim(right):
            own, total = _totals_by_pair(left, right, weights)
            codes.append(own)
            totals.append(total)
        elif np.ndim(left) or np.ndim(right):
            other = left if np.ndim(left) else right
            total = np.zeros(int(other.max()) + 1, np.int64)
            np.add.at(total, other, weights)
            own = np.flatnonzero(total)
            codes.append(own << 32 | right if np.ndim(left) else left << 32 | own)
            totals.append(total[own])
        else:
            codes.append(np.array([left << 32 | right]))
            totals.append(np.array([weights.sum()]))
    pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, place, np.concatenate(totals))
    return pairs[total != 0], total[total != 0]


def _changed(step: int, part: int, pairs: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({
        "step": pa.array(np.full(len(pairs), step, np.int32)), "left_id": pa.array((pairs >> 32).astype(np.int32)),
        "right_id": pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), "cnt": pa.array(total), "part": pa.array(np.full(len(pairs), part, np.int32))})


def _all_pairs(pending: Sequence[Merge]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chain, counts in _chains(batches, pending, len(pending)):
            yield _changed(0, part, *_summed(chain, counts, chain.pairs()))
    return run


def _step_changes(pending: Sequence[Merge], batch: Sequence[Merge]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = [*pending, *batch]
        table = PairTable(merges)
        number = dict(zip(table.codes.tolist(), table.numbers.tolist()))
        for part, chain, counts in _chains(batches, merges, len(pending)):
            for step, merge in enumerate(batch):
                pairs, total = changes_of(chain, counts, number[merge[0] << 32 | merge[1]], merge)
                if len(pairs):
                    yield _changed(step, part, pairs, total)
    return run


def _merged_blocks(pending: Sequence[Merge]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chain, counts in _chains(batches, pending, len(pending)):
            yield _block(part, chain.live(), counts)
    return run


def _bits(mask: int) -> list[int]:
    return [part for part in range(PARTS) if mask >> part & 1]


class _Words:
    """The blocks: versions of parts, each part read from the last one that has it."""

    def __init__(self, words: DataFrame, parts: int):
        self._tables = Tables(words.sparkSession)
        ranged = words.repartitionByRange(parts, "ids").withColumn("part", F.spark_partition_id())
        blocks = self._tables.replace("blocks", ranged.mapInArrow(_blocks, BLOCK_TABLE), "part", large_rows=True)
        self._versions, self._sizes, self._deltas = [(blocks, (1 << PARTS) - 1)], {}, 0
        self._measure(blocks)

    def _measure(self, blocks: DataFrame) -> None:
        self._sizes.update((r["part"], r["size"]) for r in blocks.groupBy("part").agg(F.sum("size").alias("size")).collect())

    def bytes_of(self, mask: int) -> int:
        return sum(size for part, size in self._sizes.items() if mask >> part & 1)

    def all_parts(self) -> int:
        return sum(1 << part for part in self._sizes)

    def read(self, mask: int) -> DataFrame:
        """The blocks of these parts; other folders are not opened."""
        own = [blocks.where(F.col("part").isin(_bits(mask & held))) for blocks, held in self._versions if mask & held]
        return reduce(DataFrame.unionByName, own) if own else self._versions[0][0].limit(0)

    def changes(self, mask: int, run) -> DataFrame:
        """Summed changes, and the parts of each pair as bits."""
        rows = self.read(mask).select("part", "ids", "counts").mapInArrow(run, CHANGES)
        bit = F.expr("shiftleft(1L, part % 64)")
        masks = [F.bit_or(F.when(F.floor(F.col("part") / 64) == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{k}") for k in range(PARTS // 64)]
        return rows.groupBy("step", "left_id", "right_id").agg(F.sum("cnt").alias("cnt"), *masks)

    def apply(self, pending: Sequence[Merge], mask: int) -> None:
        """Write the parts that hold one of the merged pairs again; most of them, and the others are copied too."""
        mask &= self.all_parts()
        whole = 2 * mask.bit_count() > len(self._sizes) or len(self._versions) > 3
        merged = self.read(self.all_parts() if whole else mask).select("part", "ids", "counts").mapInArrow(_merged_blocks(tuple(pending)), BLOCK_TABLE)
        if whole:
            blocks = self._tables.replace("blocks", merged, "part", large_rows=True)
            for number in range(self._deltas):
                self._tables.drop(f"delta{number}")
            self._versions, self._deltas = [(blocks, (1 << PARTS) - 1)], 0
        else:
            blocks = self._tables.replace(f"delta{self._deltas}", merged, "part", large_rows=True)
            self._versions, self._deltas = [(b, held & ~mask) for b, held in self._versions] + [(blocks, mask)], self._deltas + 1
        self._measure(blocks)

    def pairs(self, pending: Sequence[Merge]) -> DataFrame:
        """All pairs, counted in full and written."""
        return self._tables.replace("pairs", self.changes(self.all_parts(), _all_pairs(tuple(pending))))

    def delete(self) -> None:
        self._tables.delete()


CORPUS_TABLE = "ids binary, counts binary, pairs binary, totals binary"


def _totals_by_pair(left: np.ndarray, right: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct pairs, and the sum of the weights of each."""
    most = max(int(left.max(initial=0)), int(right.max(initial=0))) + 1
    codes = left.astype(np.int64) * most + right
    if most <= 1 << 11:
        totals = np.bincount(codes, weights, most * most)                  # exact: whole numbers below 2^53
        own = np.flatnonzero(totals)
        totals = totals[own].astype(np.int64)
    else:
        own, place = np.unique(codes, return_inverse=True)
        totals = np.zeros(len(own), np.int64)
        np.add.at(totals, place, weights)
    return own // most << 32 | own % most, totals


def _pair_totals(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs of words, and how often each occurs."""
    inside = np.flatnonzero((ids[:-1] != GAP) & (ids[1:] != GAP))
    word = np.cumsum(np.r_[0, ids[:-1] == GAP])[inside] if len(ids) else inside
    return _totals_by_pair(ids[inside], ids[inside + 1], counts[word])


def _with_pairs(ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A run of words with the counts of its pairs beside it."""
    pairs, totals = _pair_totals(ids, counts)
    return pa.record_batch({name: pa.array([column.tobytes()], pa.binary()) for name, column in
                            (("ids", ids), ("counts", counts), ("pairs", pairs), ("totals", totals))})


def _spelled(letters: Sequence[str]):
    """Runs of words with the counts of their pairs, and the code points that have no id."""
    codes = np.array(sorted(ord(c) for c in letters), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Letters(letters)
        for batch in batches:
            counts, at = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), 0
            for own in _runs(batch.column(0).to_pylist()):
                ids = speller.ids(own)
                row = _with_pairs(ids, counts[at:at + len(own)])
                at += len(own)
                missing = np.zeros(0, np.int32)
                if (ids == UNKNOWN_ID).any():
                    missing = np.setdiff1d(np.frombuffer("".join(own).encode("utf-32-le"), np.int32), codes)
                yield row.append_column("missing", pa.array([missing.tolist()], pa.list_(pa.int32())))
    return run


def _corpus_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for row in zip(*(batch.column(name) for name in names)):
            yield [np.frombuffer(x.as_buffer(), np.int32 if name == "ids" else np.int64) for name, x in zip(names, row)]


def _merged_corpus(merges: Sequence[Merge]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PairTable(merges)
        number = dict(zip(table.codes.tolist(), table.numbers.tolist()))
        for ids, counts in _corpus_rows(batches, "ids", "counts"):
            chain = Chain(ids, table)
            for left, right, new in merges:
                chain.merge(number[left << 32 | right], (left, right, new))
            yield _with_pairs(chain.live(), counts)
    return run


def _corpus_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pairs, totals in _corpus_rows(batches, "pairs", "totals"):
        yield pa.record_batch({"left_id": pa.array((pairs >> 32).astype(np.int32)), "right_id": pa.array((pairs & 0xFFFFFFFF).astype(np.int32)),
                               "cnt": pa.array(totals)})


def fragments_of(ids: np.ndarray, counts: np.ndarray, kept: PairTable | None) -> pa.Table:
    """(ids, n): the distinct fragments of two symbols or more, cut where the pair is none of those kept (None: all are)."""
    if not len(ids):
        return pa.table({"ids": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    joined = np.zeros(len(ids) + 1, bool)                                  # to the place before
    if kept is None:
        joined[1:-1] = (ids[:-1] != GAP) & (ids[1:] != GAP)
    else:
        joined[kept.find(ids[:-1], ids[1:])[0] + 1] = True
    live = joined[:-1] | joined[1:]                                        # gaps and single symbols are not
    starts = np.flatnonzero(live & ~joined[:-1])
    word = np.cumsum(np.r_[0, ids[:-1] == GAP])[starts]
    places = np.r_[np.cumsum(live) - live, live.sum()]
    offsets = np.r_[places[starts], places[-1]].astype(np.int32) * 4
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(ids[live].astype(">i4").tobytes())])
    summed = pa.table({"ids": column, "n": pa.array(counts[word])}).group_by("ids").aggregate([("n", "sum")])
    return summed.rename_columns({"n_sum": "n"})


def _fragments(kept: Sequence[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if kept is None else PairTable([(code >> 32, code & 0xFFFFFFFF, 0) for code in kept])
        for ids, counts in _corpus_rows(batches, "ids", "counts"):
            yield from fragments_of(ids, counts, table).select(["ids", "n"]).to_batches()
    return run


class _Corpus:
    """The words with the merges of all phases before, and the counts of their pairs."""

    def __init__(self, words: DataFrame, initial: Sequence[str]):
        """Spelled by the initial letters; only where words have others too, once more by all."""
        self._tables = Tables(words.sparkSession)
        counted = words.select("word", F.col("n").cast("bigint").alias("n"))
        self.letters = alphabet_of(initial)
        while True:
            spelled = counted.mapInArrow(_spelled(tuple(self.letters)), f"{CORPUS_TABLE}, missing array<int>")
            self._corpus = self._tables.replace("corpus", spelled, large_rows=True)
            found = self._corpus.select(F.explode("missing").alias("code")).distinct().limit(MAX_SYMBOLS).collect()
            if not found:
                break
            self.letters = alphabet_of([*self.letters, *(chr(r.code) for r in found)])

    def merge(self, merges: Sequence[Merge]) -> None:
        if merges:
            merged = self._corpus.select("ids", "counts").mapInArrow(_merged_corpus(tuple(merges)), CORPUS_TABLE)
            self._corpus = self._tables.replace("corpus", merged, large_rows=True)

    def frequent(self, min_frequency: int) -> tuple[int, int, list[int] | None]:
        """The count of the best pair, the least count of a phase, and the pairs of that count or more, None if they are too many."""
        rows = self._corpus.select("pairs", "totals").mapInArrow(_corpus_pairs, "left_id int, right_id int, cnt bigint")
        pairs = self._tables.replace("pairs", rows.groupBy("left_id", "right_id").agg(F.sum("cnt").alias("cnt")))
        top = pairs.select("cnt").orderBy(F.desc("cnt")).limit(HELD + 1)
        best, last, number = top.agg(F.max("cnt"), F.min("cnt"), F.count("*")).first()
        least = max(min_frequency, -(-(best or 0) // PHASE), last + 1 if number > HELD else 0)
        if least > (best or 0):
            return best or 0, min_frequency, None
        kept = pairs.where(F.col("cnt") >= least).select("left_id", "right_id").toArrow()
        codes = kept["left_id"].to_numpy().astype(np.int64) << 32 | kept["right_id"].to_numpy()
        return best, least, codes.tolist()

    def fragments(self, kept: Sequence[int] | None) -> DataFrame:
        """(ids, n): the distinct fragments, written."""
        found = self._corpus.select("ids", "counts").mapInArrow(_fragments(kept), "ids binary, n bigint")
        return self._tables.replace("fragments", found.groupBy("ids").agg(F.sum("n").alias("n")))

    def delete(self) -> None:
        self._tables.delete()


def train(words: DataFrame, vocab_size: int = TARGET_SIZE, initial_alphabet: Sequence[str] = tuple(cd.ALPHABET),
          min_frequency: int = MIN_FREQUENCY, keep_steps: int = 48) -> BpeModel:
    """Learn merges until the vocabulary is full or no pair occurs ``min_frequency`` times.

    ``words`` is (word, n); a word may have several rows.  ``keep_steps`` is how many merges may be pending before the blocks
    that they change are written again.
    """
    if vocab_size > MAX_SYMBOLS:
        raise ValueError(f"at most {MAX_SYMBOLS} entries fit the symbol range")
    with small_batches(words.sparkSession):
        return _learned(words, vocab_size, initial_alphabet, min_frequency, keep_steps)


def _learned(words: DataFrame, vocab_size: int, initial_alphabet: Sequence[str], min_frequency: int, keep_steps: int) -> BpeModel:
    corpus = _Corpus(words, initial_alphabet)
    model = BpeModel([*SPECIAL_TOKENS, *corpus.letters])
    known = {t: i for i, t in enumerate(model.tokens)}
    done = 0                                   # merges of the phases before
    while len(model.tokens) < vocab_size:
        corpus.merge(model.merges[done:])
        done = len(model.merges)
        best, least, kept = corpus.frequent(min_frequency)
        if best < min_frequency:
            break
        reused = _phase(corpus.fragments(kept), model, known, vocab_size, least, keep_steps, kept is not None)
        if least <= min_frequency and not reused:
            break
    corpus.delete()
    return model


def _phase(fragments: DataFrame, model: BpeModel, known: dict[str, int], vocab_size: int, least: int, keep_steps: int, cut: bool) -> bool:
    """Add the next merges of pairs that occur ``least`` times.  True if it ended with a merge that gave an old id, after which
    places that were cut may matter."""
    levels = {r["level"]: r["size"] // 4 for r in fragments.groupBy(_level().alias("level")).agg(F.sum(F.octet_length("ids")).alias("size")).collect()}
    preview = _Preview(fragments, levels)
    held = _Words(fragments, min(PARTS, max(8, sum(levels.values()) // PART)))
    ranking = _Ranking()
    ranking.load(held.pairs(()))
    pending: list[Merge] = []
    stood = GUESSES // 4
    changed, fresh, reused = 0, True, False    # parts with pending merges; the ranking was just loaded; the last merge gave an old id
    while len(model.tokens) < vocab_size and not (cut and reused):
        most = min(GUESSES, 2 * stood + 2, vocab_size - len(model.tokens))
        batch = _guessed(ranking, model, known, least, most, preview)
        if not batch and (ranking.bound is None or fresh):
            break
        if not batch or (reused and ranking.bound is not None):   # what is held ranks behind the rest, or pairs in the table may have grown
            ranking.load(held.pairs(pending))
            fresh, reused = True, False
            continue
        masks = [ranking.parts.get(left << 32 | right, 0) for left, right, _ in batch]      # a pair with a new id is where that came
        mask = reduce(int.__or__, masks)
        found = held.changes(mask, _step_changes(tuple(pending), tuple(batch))).toArrow()
        steps, stood = found["step"].to_numpy(), 0
        for step, (left, right, new) in enumerate(batch):
            if step and ranking.head(1, least) != [left << 32 | right]:
                break
            ranking.add(found.filter(pa.array(steps == step)))
            if left << 32 | right in ranking.counts:
                raise RuntimeError("pair counts do not shrink: the words changed between two reads")
            reused = new < len(model.tokens)
            if not reused:
                model.tokens.append(model.tokens[left] + model.tokens[right])
                known[model.tokens[-1]] = new
            model.merges.append((left, right, new))
            changed |= masks[step]
            stood += 1
        model.rounds.append(Round(stood, (mask & held.all_parts()).bit_count(), held.bytes_of(mask)))
        pending += batch[:stood]
        preview.merge(batch[:stood])
        fresh = False
        if len(pending) >= keep_steps:
            held.apply(pending, changed)
            pending, changed = [], 0
    held.delete()
    return cut and reused


# --- Application ------------------------------------------------------------------------------------------------
class _Encoder:
    """Applies a model to many words at a time.  Words are of symbols, or of letters if these are given."""

    def __init__(self, merges: Sequence[Merge], letters: Sequence[str] | None = None):
        self.merges, self.table = merges, PairTable(merges)
        self.spelled = flat_ids if letters is None else Letters(letters).ids
        new = [m[2] for m in merges]
        self._reuses = any(a >= b for a, b in zip(new, new[1:]))

    def encode(self, ids: np.ndarray, lost: Callable[[int, Chain, np.ndarray], None] | None = None) -> np.ndarray:
        """Always the lowest rank first and the leftmost among equals, in every word.

        Words do not meet, so the lowest rank of all words may go first; a pair made by a merge has a higher rank, unless
        some merge gave an old id: then a word's places are taken one by one.
        """
        chain = Chain(ids, self.table)
        while chain.waiting:
            rank = heapq.heappop(chain.waiting)
            at = chain.merge(rank, self.merges[rank], one_per_word=self._reuses)
            if lost and len(at):
                lost(rank, chain, at)
        return chain.live()

    def lists(self, words: Iterable[str | None], limit: int | None = None) -> Iterator[pa.Array]:
        for run in _runs(words):
            ids = self.encode(self.spelled(run))
            gaps = np.flatnonzero(ids == GAP)
            sizes = np.diff(np.r_[-1, gaps]) - 1
            if limit:
                place = np.arange(len(ids)) - np.repeat(np.r_[0, gaps[:-1] + 1], sizes + 1)
                ids, sizes = ids[(place < limit) & (ids != GAP)], np.minimum(sizes, limit)
            else:
                ids = ids[ids != GAP]
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids))

    def sizes(self, words: Iterable[str | None]) -> np.ndarray:
        parts = [np.diff(np.r_[-1, np.flatnonzero(self.encode(self.spelled(run)) == GAP)]) - 1 for run in _runs(words)]
        return np.concatenate([np.zeros(0, np.int64), *parts])


def _encoder(spark: SparkSession, model: BpeModel, kind: str, limit: int | None = None):
    """Arrow function from strings to ids (``ids``), or from arrays of strings to token counts (``sizes``)."""
    shared = spark.sparkContext.broadcast((model.merges, model.alphabet))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _Encoder(*shared.value)
        for column in columns:
            if kind == "ids":
                parts = list(encoder.lists(_texts(column), limit))
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
                continue
            sizes = encoder.sizes(_texts(column.flatten())).astype(np.int32)
            ends = np.cumsum(np.r_[0, column.value_lengths().fill_null(0).to_numpy()]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(sizes))

    return F.arrow_udf(run, "array<int>")


def encode_ids(spark: SparkSession, text: Column, model: BpeModel, limit: int | None = None) -> Column:
    """array<int> of ids, the first ``limit`` of them if given.  Characters outside the alphabet, line ends included,
    give the unknown id and no merge crosses them."""
    return _encoder(spark, model, "ids", limit=limit)(text)


def line_sizes(spark: SparkSession, lines: Column, model: BpeModel) -> Column:
    """array<int>: the number of ids of each line of an array."""
    return _encoder(spark, model, "sizes")(lines)


def token_totals(lines: DataFrame, model: BpeModel, column: str = "unicode", count_blank: bool = True) -> DataFrame:
    """(lines, tokens, tokens_per_line) of the corpus.  Lines are encoded where they are: that costs less than an exchange.

    ``count_blank`` says whether lines that are empty after stripping count as lines.
    """
    from tokenloom.functions.text import strip
    stripped = lines.select(strip(F.col(column)).alias("line"))
    if not count_blank:
        stripped = stripped.where(F.col("line") != "")
    size = F.element_at(line_sizes(lines.sparkSession, F.array("line"), model), 1)
    return totals(stripped.select(F.lit(1).alias("n"), size.alias("size")))


def totals(sized: DataFrame) -> DataFrame:
    """Fold (n, size) rows."""
    out = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"),
                    F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("tokens"))
    average = F.when(F.col("lines") > 0, F.col("tokens") / F.col("lines")).otherwise(F.lit(0.0))
    return out.withColumn("tokens_per_line", average)


def folder_totals(lines: DataFrame, model: BpeModel, column: str = "unicode") -> DataFrame:
    """(folders, files, lines, tokens, tokens_per_line) over shards; blank lines do not count.

    Needs (shard, file_id) next to the line.
    """
    seen = lines.select("shard", "file_id").distinct()
    where = seen.agg(F.count_distinct("shard").alias("folders"), F.count("*").alias("files"))
    parts = where.unionByName(token_totals(lines, model, column, count_blank=False), allowMissingColumns=True)
    return parts.agg(*(F.max(c).alias(c) for c in parts.columns))      # one row from each side


def size_sweep(words: DataFrame, model: BpeModel, sizes: Sequence[int]) -> DataFrame:
    """(vocab_size, total_tokens): the corpus under each prefix of the merge list, encoded once.

    What each merge takes off the total is added up by rank, so a size's total is known without another encoding; where
    merges gave old ids, prefixes are encoded one by one.
    """
    sizes = sorted(sizes)
    whole = model.first(sizes[-1])
    merges = [model.first(size).merges for size in sizes] if whole.reuses_ids else [whole.merges]
    ranks = [len(model.first(size).merges) for size in sizes]
    shared = words.sparkSession.sparkContext.broadcast((merges, model.alphabet))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [_Encoder(m, shared.value[1]) for m in shared.value[0]]
        lost, before, totals = np.zeros(len(whole.merges) + 1, np.int64), 0, np.zeros(len(sizes), np.int64)
        for batch in batches:
            counts, at = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), 0
            for part in _runs(batch.column(0).to_pylist()):
                own, ids = counts[at:at + len(part)], encoders[0].spelled(part)
                at += len(part)
                if len(encoders) > 1:
                    for i, encoder in enumerate(encoders):
                        ends = np.flatnonzero(encoder.encode(ids) == GAP)
                        totals[i] += ((np.diff(np.r_[-1, ends]) - 1) * own).sum()
                    continue
                before += (np.array([len(w) for w in part]) * own).sum()

                def take(rank: int, chain: Chain, at: np.ndarray) -> None:
                    lost[rank + 1] += own[chain.word[at]].sum()
                encoders[0].encode(ids, take)
        if len(encoders) == 1:
            totals = before - np.cumsum(lost)[ranks]
        yield pa.record_batch({"vocab_size": pa.array(sizes, pa.int32()), "part_tokens": pa.array(totals, pa.int64())})

    counted = words.select("word", F.col("n").cast("bigint").alias("n"))
    return counted.mapInArrow(run, "vocab_size int, part_tokens bigint").groupBy("vocab_size").agg(F.sum("part_tokens").alias("total_tokens"))
