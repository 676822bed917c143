"""Language identification (2) by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton.  A document is parsed with it: each phrase is the longest run
that occurs in the language's text.  The language whose phrases, times the logarithm of its text's length (the bits of a
pointer into it), come out fewest wins.  Texts are parsed in blocks of ``BLOCK`` letters, so thousands of blocks advance
together in one array operation, and the length of a text doesn't matter.

The automata learn from a bounded sample: of each language the ``DOCUMENTS`` labelled documents with the smallest digest
of their id, and of each a run of ``RUN`` characters at a place drawn from the digest.  All else covers all rows.

Defined cases: null text and text without a letter give ``und`` and score 0; ties go to the language with more labelled
documents in the sample, then to the smaller name; without any labelled row all are ``und``; with one language the score
is 1; a null id is drawn as the string ``null``; repeated rows are rows of their own; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.words import row_runs

DOCUMENTS, RUN = 96, 400       # the bound of the training sample, for each language
LANGUAGES = 200                # more labels than this are an error
LETTERS = 0x110000             # code points; all letters of the sample are learned
BLOCK = 256
HELD = 4                       # every so many run of the sample is parsed with what the others teach
USUAL, SPARE, SLACK = 0.9, 1.5, 4   # bits per letter that so many of those need, times what other text may need, and phrases besides
SEGMENT = 1 << 20              # characters of a text that are parsed at a time
UNKNOWN = "und"


def remainder(key: Column) -> Column:
    """crc32 of the id as text, mod 4."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % 4


def training_sample(labelled: DataFrame, id_column: str, text_column: str, lang_column: str) -> list[tuple[str, list[str]]]:
    """For each language its runs of text; the rows that the window drops never leave their task."""
    text, digest = F.col(text_column).cast("string"), F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    start = F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % F.greatest(F.length(text) - RUN, F.lit(1)) + 1
    runs = labelled.where(F.col(lang_column).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang_column).cast("string").alias("lang"), digest.alias("digest"), text.substr(start.cast("int"), F.lit(RUN)).alias("run"))
    sizes = {r["lang"]: r["count"] for r in runs.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # A few times the documents needed pass by the size of their digest, however many there are.
    place, passes = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / float(1 << 32), F.lit(False)
    for lang, size in sorted(sizes.items()):
        passes = passes | ((F.col("lang") == lang) & (place < 8 * DOCUMENTS / size))
    runs = runs.where(passes)
    order = Window.partitionBy("lang").orderBy("digest", "run")
    held: dict[str, list[str]] = {}
    for row in runs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= DOCUMENTS).orderBy("lang", "n").collect():
        held.setdefault(row["lang"], []).append(row["run"])
    return sorted(held.items(), key=lambda x: (-len(x[1]), x[0]))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that reads exactly the substrings."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p, last = last, new
        while p >= 0 and symbol not in step[p]:
            step[p][symbol] = new
            p = link[p]
        if p < 0:
            continue
        q = step[p][symbol]
        if length[q] != length[p] + 1:
            copy = len(step)
            step.append(dict(step[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = copy
            while p >= 0 and step[p].get(symbol) == q:
                step[p][symbol] = copy
                p = link[p]
            q = copy
        link[new] = q
    return step


def hashed(keys: np.ndarray, size: int) -> np.ndarray:
    """The first place of each key in a table of ``size`` places, a power of two."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their values at the first free place from their own on, at most half full; -1 where free."""
    size = 1 << max(4, int(2 * len(keys)).bit_length())
    held, out = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    place, waiting = hashed(keys, size), np.arange(len(keys))
    while len(waiting):
        at, own = place[waiting], keys[waiting]
        free = held[at] < 0
        held[at[free]] = own[free]
        won = held[at] == own
        out[at[won]] = values[waiting[won]]
        waiting = waiting[~won]
        place[waiting] = (place[waiting] + 1) & (size - 1)
    return held, out


class Model:
    """``symbol`` maps code points to 0 (no letter), 1 (a letter not learned) and learned letters.  ``keys`` and ``next`` are
    a hash table from state and symbol to the next state within a phrase; for all others ``first`` has, by language and
    symbol, the state after the phrase's end and that symbol.  ``roots`` and ``bits`` by language."""

    def __init__(self, names: list[str], symbol: np.ndarray, keys: np.ndarray, next_: np.ndarray, first: np.ndarray,
                 roots: np.ndarray, bits: np.ndarray):
        self.names, self.symbol, self.keys, self.next, self.first = names, symbol, keys, next_, first
        self.roots, self.bits = roots, bits

    def parts(self) -> tuple:
        return self.names, self.symbol, self.keys, self.next, self.first, self.roots, self.bits

    def step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states (a row for each language), and where a phrase began."""
        key = (state * self.first.shape[1] + symbols).ravel()
        place = hashed(key, len(self.keys))
        held = self.keys[place]
        more = np.flatnonzero((held != key) & (held >= 0))
        while len(more):
            place[more] = (place[more] + 1) & (len(self.keys) - 1)
            now = self.keys[place[more]]
            held[more] = now
            more = more[(now != key[more]) & (now >= 0)]
        begins = (held != key).reshape(state.shape)
        return np.where(begins, self.first[:, symbols], self.next[place].reshape(state.shape)), begins

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, each led by a 0, runs of 0 as one; and where each text starts."""
        texts = [t.lower() for t in texts]
        raw = np.frombuffer("\n".join(["", *texts]).encode("utf-32-le", "replace"), np.uint32)
        found = self.symbol[raw]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        keep = np.r_[True, (found[1:] != 0) | (found[:-1] != 0)]
        keep[starts[:-1]] = True
        return found[keep], np.r_[0, np.cumsum(keep)][starts]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its phrases by language, its letters, and its learned letters."""
        found, starts = self.symbols(texts)
        letters = np.r_[0, np.cumsum(found > 0)]
        learned = np.r_[0, np.cumsum(found > 1)]
        sizes = np.diff(starts)
        blocks = -(-sizes // BLOCK)
        first = np.r_[0, np.cumsum(blocks)]
        begin = np.repeat(starts[:-1], blocks) + BLOCK * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
        size = np.minimum(BLOCK, np.repeat(starts[1:], blocks) - begin)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        active = np.searchsorted(-size, -np.arange(BLOCK), "left")        # blocks longer than each step
        count = np.zeros((len(self.names), len(size)), np.int32)
        state = np.repeat(self.roots[:, None], len(size), 1)
        for t in range(int(size[0]) if len(size) else 0):
            n = active[t]
            state[:, :n], begins = self.step(state[:, :n], found[begin[:n] + t])
            count[:, :n] += begins
        unsorted = np.empty_like(count)
        unsorted[:, order] = count
        total = np.c_[np.zeros((len(self.names), 1), np.int64), np.cumsum(unsorted, axis=1)]
        return total[:, first[1:]] - total[:, first[:-1]], np.diff(letters[starts]), np.diff(learned[starts])

    def best(self, texts: list[str | None]) -> list[tuple[str, float, int, int, float]]:
        """Language, score (how far the runner-up's bits exceed the winner's), letters, learned letters and the winner's bits."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for at in range(0, max(len(text or ""), 1), SEGMENT):
                pieces.append((text or "")[at:at + SEGMENT])
                owner.append(i)
        bits = np.zeros((len(self.names), len(texts)))
        letters, learned = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(pieces):                          # about a segment at a time
            end, held = at, 0
            while end < len(pieces) and (end == at or held + len(pieces[end]) <= SEGMENT):
                held += len(pieces[end])
                end += 1
            found, all_letters, known = self.phrases(pieces[at:end])
            np.add.at(bits.T, owner[at:end], (found * self.bits[:, None]).T)
            np.add.at(letters, owner[at:end], all_letters)
            np.add.at(learned, owner[at:end], known)
            at = end
        out = []
        for i in range(len(texts)):
            if not letters[i] or not self.names:
                out.append((UNKNOWN, 0.0, int(letters[i]), int(learned[i]), 0.0))
                continue
            own = bits[:, i]
            win = int(np.argmin(own))
            rest = np.delete(own, win)
            score = 1.0 - own[win] / rest.min() if len(rest) else 1.0
            out.append((self.names[win], float(min(1.0, max(0.0, score))), int(letters[i]), int(learned[i]), float(own[win])))
        return out


def learn(sample: list[tuple[str, list[str]]]) -> Model:
    letters = sorted({c for _, runs in sample for c in "".join(runs).lower() if c.isalpha()})
    symbol = np.zeros(LETTERS, np.int32)
    symbol[[i for i in range(LETTERS) if chr(i).isalpha()]] = 1
    for number, letter in enumerate(letters):
        symbol[ord(letter)] = number + 2
    nothing = np.zeros((0, 0), np.int32)
    reader = Model([], symbol, nothing, nothing, nothing, nothing, nothing)
    width, size, bits, roots = len(letters) + 2, 0, [], []
    keys, values, first = [], [], np.zeros((len(sample), width), np.int32)
    for number, (_, runs) in enumerate(sample):
        text = reader.symbols([" ".join(runs)])[0]
        states = suffix_automaton(text.tolist())
        bits.append(np.log2(max(len(text), 2)))
        roots.append(size)
        first[number] = size                                             # an unknown symbol is a phrase of its own
        for symbol_, state in states[0].items():
            first[number, symbol_] = size + state                        # a phrase ends, the next begins with this symbol
        inner = [(state + size) * width + symbol_ for state, steps in enumerate(states) if state for symbol_ in steps]
        keys.append(np.array(inner, np.int64))
        values.append(np.array([size + x for steps in states[1:] for x in steps.values()], np.int32))
        size += len(states)
    held, next_ = hash_table(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int32), *values]))
    return Model([n for n, _ in sample], symbol, held, next_, first, np.array(roots, np.int64), np.array(bits))


def limits(sample: list[tuple[str, list[str]]]) -> dict[str, float]:
    """Bits per letter that text of each language may need: every ``HELD``-th run is parsed with the automaton of the others.
    Copies of those say nothing; a language that has no other run has no limit."""
    others = [(name, [run for n, run in enumerate(runs) if n % HELD]) for name, runs in sample]
    model, out = learn(others), {}
    for number, (name, runs) in enumerate(sample):
        own = [run for run in runs[::HELD] if run not in others[number][1]]
        if not own or not others[number][1]:
            continue
        found, letters, _ = model.phrases(own)
        if letters.any():
            need = found[number][letters > 0] * model.bits[number] / letters[letters > 0]
            out[name] = SPARE * float(np.quantile(need, USUAL))
    return out


def fits(bits: float, letters: int, limit: float, bits_of_phrase: float) -> bool:
    """A text of a few phrases says too little to be rejected."""
    return bits <= limit * letters + SLACK * bits_of_phrase


def learned(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    return learn(training_sample(labelled, id_column, text_column, lang_column))


def _guess(shared, position: int):
    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in (x.slice(a, b - a) for x in batches for a, b in row_runs(x.column(position), SEGMENT)):
            found = model.best(batch.column(position).to_pylist())
            lang, score, letters, learned_letters, _ = zip(*found) if found else ((), (), (), (), ())
            yield pa.record_batch({"_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()),
                                   "score": pa.array(score, pa.float64()), "n_letters": pa.array(letters, pa.int64()),
                                   "n_learned": pa.array(learned_letters, pa.int64())})
    return guess


def predicted(spark: SparkSession, docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``lang_pred``, ``score``, and how many letters it has and the model knows."""
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_guess(spark.sparkContext.broadcast(model.parts()), 1),
                           f"_id {kind}, lang_pred string, score double, n_letters bigint, n_learned bigint")


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that aren't held out, and predict all."""
    model = learned(docs.where(remainder(F.col("doc_id")) != 2))
    return predicted(spark, docs, model).select(
        F.col("_id").alias("doc_id"), (remainder(F.col("_id")) == 2).alias("held_out"), "lang_pred", "score")


def _accepts(shared, languages: frozenset[str] | None):
    """Arrow function from texts to whether they stay; rows themselves never leave the JVM."""
    def accept(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts, limit = shared.value
        model = Model(*parts)
        pointer = dict(zip(model.names, model.bits))
        for column in columns:
            keep = [letters > 0 and (not model.names or 2 * known >= letters and (languages is None or lang in languages)
                                     and fits(bits, letters, limit.get(lang, np.inf), pointer[lang]))
                    for a, b in row_runs(column, SEGMENT) for lang, _, letters, known, bits in model.best(column.slice(a, b - a).to_pylist())]
            yield pa.array(keep, pa.bool_())
    return F.arrow_udf(accept, "boolean")


def in_known_languages(spark: SparkSession, docs: DataFrame, languages: frozenset[str] | None = None,
                       text_column: str = "text") -> DataFrame:
    """The documents with a letter, at least half of whose letters belong to a learned alphabet, that need no more bits in
    the language that wins than its text may (``limits``), in one of ``languages`` if given.  Others are rejected: they have
    no language, or one that no labelled text is written in.  Where no row is labelled, all documents with a letter stay."""
    sample = training_sample(docs.where(remainder(F.col("doc_id")) != 2), "doc_id", "text", "lang")
    shared = spark.sparkContext.broadcast((learn(sample).parts(), limits(sample)))
    return docs.where(_accepts(shared, languages)(F.col(text_column).cast("string")))
