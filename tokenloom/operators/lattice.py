"""A subword tokenizer to compare with: a unigram vocabulary, and the cheapest cut of each word.

The vocabulary is learned from the corpus: all characters, and the substrings of words that cover most text.  A piece costs
its negative log-frequency.  Each word is a lattice of the pieces that begin at its places, found by a trie, and Viterbi
search takes the path of least cost, of equal ones that with fewer pieces, then the longest last piece.  After a
pass frequencies are those of the pieces that were used, and pieces that were not used go.

Words are distinct before they are cut, so each is cut once.  The vocabulary is bounded by its size and broadcast.  Tasks walk
the trie from all places of many words at a time and fill the paths position by position for all words together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.session import Tables

LONGEST = 8                # characters of a piece
MAX_PIECES = 1 << 17       # a larger vocabulary is an error; all characters of the corpus must fit
UNIT = 1000                # costs are whole numbers of 1/UNIT bits
UNKNOWN = 10 * UNIT        # what a character that the vocabulary lacks costs more than its dearest piece
WORD = r"\S+"
BATCH = 1 << 19            # characters that are cut at a time
_PIECES_BITS = 24          # of a path's key; the cost stands above


def word_counts(files: DataFrame, column: str = "content") -> DataFrame:
    """(word, n): the distinct runs of characters that aren't blank."""
    words = files.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def cost_of(count: Column, total: Column) -> Column:
    return F.floor(UNIT * F.log2(total / count) + 0.5)


def _with_costs(pieces: DataFrame) -> DataFrame:
    """(piece, cost) of (piece, c)."""
    pieces = Tables(pieces.sparkSession).replace("pieces", pieces)
    total = pieces.agg(F.sum("c").cast("double")).scalar()
    return pieces.select("piece", cost_of(F.col("c"), total).alias("cost"))


def seed_pieces(words: DataFrame, size: int) -> DataFrame:
    """(piece, c): all characters, and up to ``size`` pieces in all the substrings that cover most characters of the words."""
    place = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")
    each = words.select("word", "n", place).select("word", "n", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("word") - F.col("i") + 1))).alias("l"))
    found = each.select(F.expr("substring(word, i, l)").alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("c"))
    found = Tables(words.sparkSession).replace("substrings", found)
    characters = found.where(F.length("piece") == 1)
    number = characters.count()
    if max(number, size) > MAX_PIECES:
        raise ValueError(f"at most {MAX_PIECES} pieces")
    longer = found.where(F.length("piece") > 1).orderBy((F.col("c") * F.length("piece")).desc(), "piece").limit(max(0, size - number))
    return characters.unionByName(longer)


class Trie:
    """Pieces by their characters; a step is exact: a state and a character are one key."""

    def __init__(self, pieces: list[tuple[str, int]]):
        state, keys, nexts = {"": 0}, [-1], [-1]
        for piece, _ in pieces:
            for end in range(1, len(piece) + 1):
                if piece[:end] not in state:
                    keys.append(state[piece[:end - 1]] << 21 | ord(piece[end - 1]))
                    nexts.append(len(state))
                    state[piece[:end]] = len(state)
        order = np.argsort(np.array(keys, np.int64))
        self._keys, self._nexts = np.array(keys, np.int64)[order], np.array(nexts, np.int64)[order]
        self._piece = np.full(len(state) + 1, -1, np.int64)                    # the last entry is for no state
        self._piece[[state[piece] for piece, _ in pieces]] = np.arange(len(pieces))
        # The key of a path adds up costs and, below, numbers of pieces.
        self._key = np.array([(cost << _PIECES_BITS) + 1 for _, cost in pieces] + [-1], np.int64)
        self._unknown = ((max((cost for _, cost in pieces), default=0) + UNKNOWN) << _PIECES_BITS) + 1
        self._longest = max((len(piece) for piece, _ in pieces), default=1)

    def _found(self, letters: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For each length and place the piece there, or -1; ``left`` are the characters up to the end of the word."""
        states, found = np.zeros(len(letters), np.int64), []
        for size in range(self._longest):
            alive = (states >= 0) & (left > size)
            key = np.where(alive, (states << 21) | np.r_[letters[size:], np.zeros(min(size, len(letters)), np.int64)], -2)
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            states = np.where(self._keys[at] == key, self._nexts[at], -1)
            found.append(self._piece[states])
        return np.stack(found)

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of pieces of each word; and all pieces used (-1 for an unknown character), with the word of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        found = self._found(letters, np.repeat(starts + sizes, sizes) - np.arange(len(letters)))
        costs = self._key[found]
        costs[0] = np.where(costs[0] < 0, self._unknown, costs[0])
        # A word has one place more than letters: the key of the best path to it, and the length of its last piece.
        base = starts + np.arange(len(words))
        best = np.full(len(letters) + len(words), np.iinfo(np.int64).max, np.int64)
        last = np.zeros(len(best), np.int64)
        best[base] = 0
        most = int(sizes.max(initial=0))
        order = np.argsort(-sizes, kind="stable")
        active = np.searchsorted(-sizes[order], -np.arange(most), "left")      # words longer than each place
        for place in range(most):
            own = order[:active[place]]
            here, letter = base[own] + place, starts[own] + place
            for size in range(1, self._longest + 1):
                step = costs[size - 1, letter]
                take = np.flatnonzero(step >= 0)
                there, key = here[take] + size, best[here[take]] + step[take]
                better = key < best[there]                                     # of equal keys the earlier place stays
                best[there[better]], last[there[better]] = key[better], size
        pieces, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        word = np.flatnonzero(sizes)
        end = (base + sizes)[word]
        while len(word):                                                       # back along all words at a time
            size = last[end]
            end = end - size
            pieces.append(found[size - 1, end - word])
            owners.append(word)
            more = end > base[word]
            end, word = end[more], word[more]
        return best[base + sizes] & (1 << _PIECES_BITS) - 1, np.concatenate(pieces), np.concatenate(owners)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        first, held = 0, 0
        for row, word in enumerate(words):
            held += len(word)
            if held >= BATCH or row + 1 == len(words):
                yield words[first:row + 1], counts[first:row + 1]
                first, held = row + 1, 0


def _collected(pieces: DataFrame) -> list[tuple[str, int]]:
    return [(r["piece"], r["cost"]) for r in pieces.orderBy("piece").collect()]


def used_pieces(words: DataFrame, pieces: list[tuple[str, int]]) -> DataFrame:
    """(piece, c): how often each piece is used; characters stay in the vocabulary with one use at least."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = Trie(shared.value), np.zeros(len(shared.value), np.int64)
        for own, counts in _runs(batches):
            _, used, owners = trie.cut(own)
            np.add.at(total, used[used >= 0], counts[owners[used >= 0]])
        number = np.flatnonzero(total)
        yield pa.record_batch({"piece": pa.array([shared.value[i][0] for i in number], pa.string()), "c": pa.array(total[number])})

    once = spark.createDataFrame([(p, 0) for p, _ in pieces if len(p) == 1], "piece string, c bigint")
    found = words.select("word", "n").mapInArrow(run, "piece string, c bigint").unionByName(once)
    return found.groupBy("piece").agg(F.greatest(F.sum("c"), F.lit(1).cast("bigint")).alias("c"))


def learn(words: DataFrame, size: int, passes: int = 1) -> list[tuple[str, int]]:
    """The vocabulary: pieces and costs, in order of the piece."""
    pieces = _collected(_with_costs(seed_pieces(words, size)))
    for _ in range(passes):
        pieces = _collected(_with_costs(used_pieces(words, pieces)))
    return pieces


def total_tokens(words: DataFrame, pieces: list[tuple[str, int]]) -> DataFrame:
    """(total_tokens): pieces of all words."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for own, counts in _runs(batches):
            yield pa.record_batch({"tokens": pa.array([int((trie.cut(own)[0] * counts).sum())], pa.int64())})

    sized = words.select("word", F.col("n").cast("bigint").alias("n")).mapInArrow(run, "tokens bigint")
    return sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"))
