"""Benchmark decontamination (9): documents that hold passages of test items.

The items' word windows become a sorted array of hashes that is broadcast; tasks scan the windows of whole texts
against it, verify hits word by word, and report the spans.  A broadcast holds at most ``block`` windows, which bounds
its size; a larger benchmark is taken in blocks of items, each with a pass over the documents, and the hits are joined
by row.

Defined cases: null and empty texts have no words; an item without words never occurs; an item of fewer words than a
window is one window; items with equal windows are all reported; a null item id is reported as the string ``null``;
overlapping hits count a word once; repeated rows are reported each; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.words import WordHasher, hashed_words, letter_words, text_bytes, windows
from tokenloom.session import Tables

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 1 << 18         # windows, and items of windows, of a broadcast: some 75 MB with their words


def item_windows(benchmark: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """The distinct windows of all items: ``window`` (words) and ``items`` (sorted ids as strings)."""
    words = F.regexp_extract_all(F.translate(F.col(text_column).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                             "abcdefghijklmnopqrstuvwxyz"),
                                 F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    split = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("item"), words.alias("w"))
    split = split.where("size(w) > 0")
    each = split.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("i"))
    each = each.select("item", F.array_join(F.expr(f"slice(w, i, {size})"), " ").alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _by_size(hasher: WordHasher, held: list[tuple[bytes, list[str]]]) -> dict[int, tuple[np.ndarray, list[bytes], list[list[str]]]]:
    """For each number of words the sorted hashes of the windows, their words and items."""
    out = {}
    for size in {w.count(b" ") + 1 for w, _ in held}:
        own = [x for x in held if x[0].count(b" ") + 1 == size]
        column = pa.array([w.decode() for w, _ in own])
        hashes = np.concatenate([windows(h[a:b], size) for _, h, bounds in hashed_words(hasher, column)
                                 for a, b in zip(bounds[:-1], bounds[1:])])
        order = np.argsort(hashes, kind="stable")
        out[size] = hashes[order], [own[i][0] for i in order], [own[i][1] for i in order]
    return out


SPANS = "array<struct<start:bigint,end:bigint,first_word:bigint,words:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64())]))


def _same(known: np.ndarray, texts: list[bytes], k: int, own: bytes) -> int | None:
    """The window with these words among those with the same hash, the first of which is ``k``."""
    target = known[k]
    while k < len(texts) and known[k] == target:
        if texts[k] == own:
            return k
        k += 1
    return None


class _Scanner:
    """Looks for the windows in texts; held by a task."""

    def __init__(self, held: list[tuple[bytes, list[str]]]):
        self._hasher, self._word = WordHasher(letter_words()), re.compile(WORD)
        self._by_size = _by_size(self._hasher, held)

    def _occurrences(self, hashes: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each row its possible hits: first word, number of words, place of the hash."""
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for size, (known, _, _) in self._by_size.items():
            runs = windows(hashes, size)
            if len(runs):
                at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
                for start in np.flatnonzero(known[at] == runs).tolist():
                    own = int(np.searchsorted(bounds, start, "right")) - 1
                    if start + size <= bounds[own + 1]:
                        hits.setdefault(own, []).append((start - int(bounds[own]), size, int(at[start])))
        return hits

    def rows(self, column: pa.Array, only_hits: bool) -> list[tuple[int, int, int, list[str], list[dict]]]:
        """Row, words, hit words, items and spans of each text."""
        data, offsets = text_bytes(column)
        rows = []
        for row, hashes, bounds in hashed_words(self._hasher, column):
            hits = self._occurrences(hashes, bounds)
            for i in range(len(bounds) - 1):
                count = int(bounds[i + 1] - bounds[i])
                if i not in hits:
                    if not only_hits:
                        rows.append((row + i, count, 0, [], []))
                    continue
                text = bytes(data[offsets[row + i]:offsets[row + i + 1]])
                places = [m.span() for m in self._word.finditer(text.lower())]       # of bytes, A-Z alone are lowered
                marked, found, hit = np.zeros(count, bool), set(), False
                for start, size, k in hits[i]:
                    known, texts, items = self._by_size[size]
                    own = b" ".join(text[a:b].lower() for a, b in places[start:start + size])
                    if (k := _same(known, texts, k, own)) is not None:
                        marked[start:start + size] = hit = True
                        found.update(items[k])
                edges = np.flatnonzero(np.diff(np.r_[False, marked, False].astype(np.int8))).tolist()
                spans = [{"start": places[a][0], "end": places[b - 1][1], "first_word": a, "words": b - a}
                         for a, b in zip(edges[::2], edges[1::2])]
                if hit or not only_hits:
                    rows.append((row + i, count, int(marked.sum()), sorted(found), spans))
        return rows


def _scan(shared, only_hits: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(shared.value)
        for batch in batches:
            if rows := scanner.rows(batch.column(1), only_hits):
                index, counts, hit, found, spans = zip(*rows)
                yield pa.record_batch({
                    "_id": batch.column(0).take(pa.array(index, pa.int64())), "n_words": pa.array(counts, pa.int64()),
                    "n_hit": pa.array(hit, pa.int64()), "items": pa.array(found, pa.list_(pa.string())),
                    "spans": pa.array(spans, _SPANS)})
    return scan


def _union_of_spans(spans: str) -> str:
    """SQL that joins overlapping and touching spans of words."""
    def last(field: str) -> str:
        return f"element_at(acc, -1).{field}"
    longer = f"greatest({last('first_word')} + {last('words')}, x.first_word + x.words) - {last('first_word')}"
    joined = (f"named_struct('start', {last('start')}, 'end', greatest({last('end')}, x.end), "
              f"'first_word', {last('first_word')}, 'words', {longer})")
    return (f"aggregate(array_sort({spans}, (l, r) -> CAST(l.first_word - r.first_word AS INT)), CAST(array() AS {SPANS}), "
            f"(acc, x) -> CASE WHEN size(acc) > 0 AND x.first_word <= {last('first_word')} + {last('words')} "
            f"THEN concat(slice(acc, 1, size(acc) - 1), array({joined})) ELSE concat(acc, array(x)) END)")


def scan_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = BLOCK,
                   id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``n_words``, ``n_hit``, ``items`` (strings, sorted), ``spans`` (bytes and words)."""
    found = Tables(spark).replace("windows", item_windows(benchmark, size, item_column, item_text))
    weight = found.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    blocks = max(1, -(-weight // block))
    key = F.col(id_column)
    if blocks > 1:        # hits of several passes are joined by id and text
        key = F.struct(key.alias("id"), F.md5(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("digest"))
    texts = docs.select(key.alias("_id"), F.col(text_column).cast("string").alias("_text"))
    schema = f"_id {texts.schema['_id'].dataType.simpleString()}, n_words bigint, n_hit bigint, items array<string>, spans {SPANS}"

    def passed(number: int | None) -> DataFrame:
        own = [] if number is None else [
            (r["window"].encode(), r["items"]) for r in
            found.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == number).toLocalIterator()]
        return texts.mapInArrow(_scan(spark.sparkContext.broadcast(own), blocks > 1 and number is not None), schema)

    if blocks == 1:
        return passed(0)
    hits = passed(0)
    for number in range(1, blocks):
        hits = hits.unionAll(passed(number))
    merged = hits.dropDuplicates(["_id", "items", "spans"]).groupBy("_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("_spans")).withColumn("spans", F.expr(_union_of_spans("_spans")))
    merged = merged.withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, x) -> a + x.words)"))
    base = passed(None).select("_id", "n_words")
    return base.join(merged.drop("_spans"), "_id", "left").select(
        F.col("_id.id").alias("_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.expr("array()")).alias("items"),
        F.coalesce("spans", F.expr(f"CAST(array() AS {SPANS})")).alias("spans"))


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = BLOCK) -> DataFrame:
    """The scan with a digest of the items in place of the spans."""
    scanned = scan_documents(spark, docs, benchmark, size, block)
    return scanned.select(
        F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _hit_spans(shared):
    """Arrow function from texts to the spans to remove; rows themselves never leave the JVM."""
    def spans(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = _Scanner(shared.value)
        for column in columns:
            found: list[list[dict]] = [[]] * len(column)
            for row, _, _, _, own in scanner.rows(column, True):
                found[row] = own
            yield pa.array(found, _SPANS)
    return F.arrow_udf(spans, SPANS)


def _without_spans(text: str, spans: str) -> Column:
    """The text without its spans of bytes; texts without spans as they are."""
    raw = f"CAST({text} AS BINARY)"
    return F.expr(
        f"CASE WHEN size({spans}) = 0 OR {text} IS NULL THEN {text} ELSE CAST(aggregate({_union_of_spans(spans)}, "
        f"named_struct('at', 0L, 'kept', X''), (acc, x) -> named_struct('at', x.end, 'kept', "
        f"concat(acc.kept, substring({raw}, CAST(acc.at + 1 AS INT), CAST(x.start - acc.at AS INT)))), "
        f"acc -> concat(acc.kept, substring({raw}, CAST(acc.at + 1 AS INT)))) AS STRING) END")


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents",
                   block: int = BLOCK, text_column: str = "text", item_column: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """``docs`` without hit documents, or (``remove="spans"``) without the hit spans.

    Each block of windows is a pass over the original texts, written before the next one so that a task holds one block
    alone; the spans of all blocks are joined and cut out once, so the result does not depend on the blocks.
    """
    tables = Tables(spark)
    found = tables.replace("windows", item_windows(benchmark, size, item_column, item_text))
    weight = found.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    blocks = max(1, -(-weight // block))
    columns, spans = docs.columns, "_spans"
    while spans in columns:
        spans += "_"
    text = f"`{text_column.replace('`', '``')}`"
    rows = docs.withColumn(spans, F.expr(f"CAST(array() AS {SPANS})")) if remove == "spans" else docs
    for number in range(blocks):
        own = [(r["window"].encode(), []) for r in
               found.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == number).toLocalIterator()]
        hits = _hit_spans(spark.sparkContext.broadcast(own))(F.expr(f"CAST({text} AS STRING)"))
        rows = rows.withColumn(spans, F.concat(spans, hits)) if remove == "spans" else rows.where(F.size(hits) == 0)
        if blocks > 1:
            rows = tables.replace("rows", rows)
    return rows.withColumn(text_column, _without_spans(text, spans)).select(*(f"`{c}`" for c in columns)) if remove == "spans" else rows
