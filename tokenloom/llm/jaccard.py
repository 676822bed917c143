"""N-gram Jaccard join (4): rare-first prefix filtering with length, positional and suffix filters.

Texts become sets of word shingles.  All sets are put into one order of shingles, rare ones first.  Two sets as similar
as asked share a shingle within the first fifth of either (prefix filter); the smaller one even within its first ninth.
Candidates are joined on these shingles and on a size class (length filter), kept if the shingles still to come can
make up the overlap (positional filter), and verified once per pair, where partition counts (suffix filter) spare most
intersections.

Groups of copies do not make pairs: equal sets are one node; each bucket first links to its most central set (the one
where the shared shingle comes earliest), and only sets that are still in different components are paired after that.

How the order is made: a pass counts 2^32 cells of shingle hashes over all texts.  What travels from it is bounded: a
bitmap of 2^26 bits (cells that occur once in all texts certainly match nothing) and the levels of at most ``HEAVY``
most frequent cells.  Any order gives the same result; a good one gives few candidates.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text with fewer words than a
shingle is one shingle; repeated rows are copies; repeated ids are rows of their own; extra columns are ignored; an
empty table gives an empty result; a null id is kept, and a component of null ids alone has a null id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.graph import components
from tokenloom.llm.skew import join_groups
from tokenloom.llm.words import WordHasher, hashed_words, space_words, windows
from tokenloom.session import Tables

RANGES = 1024          # ranges of the 2^32 cells; a reducer holds one of them
BITS = 16              # bits of the bitmap per range, as a power of two: 2^26 in all
HEAVY = 1 << 20        # frequent cells that travel to all tasks, 5 bytes each
LEAST = 4              # cells counted at least 2^LEAST times may be among them
FLUSH = 1 << 21        # shingles a task gathers before it sends its counts
RATIO = 1.03           # sizes within a class


def shingle_sets(hasher: WordHasher, column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles."""
    for _, hashes, bounds in hashed_words(hasher, column):
        runs = windows(hashes, words)
        for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if end - first >= words:
                yield np.unique(runs[first:end - words + 1])
            else:
                yield windows(hashes[first:end], end - first) if end > first else np.zeros(0, np.uint64)


def _count_cells(words: int):
    """Counts of cells, by range: differences of sorted cells and their counts, as bytes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(space_words()), [], 0

        def sent() -> pa.RecordBatch:
            cells, counts = np.unique((np.concatenate(held) >> np.uint64(32)).astype(np.uint32), return_counts=True)
            ranges = (cells >> np.uint32(22)).astype(np.int64)
            own, first = np.unique(ranges, return_index=True)
            ends = [*first[1:].tolist(), len(cells)]
            steps = [np.diff(cells[a:b] & np.uint32((1 << 22) - 1), prepend=np.uint32(0)) for a, b in zip(first, ends)]
            return pa.record_batch({"range": pa.array(own, pa.int32()),
                                    "steps": pa.array([x.tobytes() for x in steps], pa.binary()),
                                    "counts": pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in
                                                        zip(first, ends)], pa.binary())})

        for batch in batches:
            for own in shingle_sets(hasher, batch.column(0), words):
                held.append(own)
                size += len(own)
                if size >= FLUSH:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()
    return count


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range come together: its bitmap of repeated cells, its frequent cells and their levels.

    At most the 2^22 cells of one range and a share of new ones are held.
    """
    held, size, current = [], 0, None

    def merged() -> tuple[np.ndarray, np.ndarray]:
        cells, counts = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        return cells[first], np.add.reduceat(counts, first)

    def result() -> pa.RecordBatch:
        cells, total = merged()
        bits = np.zeros(1 << BITS, bool)
        bits[cells[total > 1] >> np.uint32(22 - BITS)] = True
        heavy = total >= 1 << LEAST
        levels = np.floor(np.log2(total[heavy])).astype(np.uint8)
        return pa.record_batch({"range": pa.array([current], pa.int32()),
                                "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
                                "cells": pa.array([(cells[heavy] + np.uint32(current << 22)).tobytes()], pa.binary()),
                                "levels": pa.array([levels.tobytes()], pa.binary()),
                                "histogram": pa.array([np.bincount(levels, minlength=64).tolist()],
                                                      pa.list_(pa.int64()))})

    for batch in batches:
        for number, steps, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if number != current:
                if current is not None:
                    yield result()
                held, size, current = [], 0, number
            cells = np.cumsum(np.frombuffer(steps.as_buffer(), np.uint32), dtype=np.uint32)
            held.append((cells, np.frombuffer(counts.as_buffer(), np.uint32).astype(np.uint64)))
            size += len(cells)
            if size > 1 << 21:
                held = [merged()]
                size = len(held[0][0]) // 2
    if current is not None:
        yield result()


def _above(least: int):
    """Cut the frequent cells of each range to those of a level, and more."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(0)]
            levels = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(1)]
            yield pa.record_batch({
                "cells": pa.array([c[x >= least].tobytes() for c, x in zip(cells, levels)], pa.binary()),
                "levels": pa.array([x[x >= least].tobytes() for x in levels], pa.binary())})
    return cut


class Order:
    """The order of shingles: 0 occur once, 1 are rare, others by the level of their frequency."""

    def __init__(self, bitmap: np.ndarray, cells: np.ndarray, levels: np.ndarray):
        self.bitmap, self.cells, self.levels = bitmap, cells, levels

    def ranks(self, shingles: np.ndarray) -> np.ndarray:
        cells = (shingles >> np.uint64(32)).astype(np.uint32)
        folded = cells >> np.uint32(22 - BITS)
        ranks = (self.bitmap[folded >> np.uint32(3)] >> (folded & np.uint32(7)).astype(np.uint8)) & np.uint8(1)
        if len(self.cells):
            at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
            found = self.cells[at] == cells
            ranks[found] = self.levels[at[found]]
        return ranks


def shingle_order(tables: Tables, texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmap, frequent cells and their levels, for ``Order``."""
    blobs = texts.select("_text").mapInArrow(_count_cells(words), "range int, steps binary, counts binary")
    sums = tables.replace("cells", blobs.repartition("range").sortWithinPartitions("range").mapInArrow(
        _sum_cells, "range int, bits binary, cells binary, levels binary, histogram array<bigint>"))
    histogram = np.zeros(64, np.int64)
    bitmap = np.zeros(RANGES << (BITS - 3), np.uint8)
    for row in sums.select("range", "bits", "histogram").collect():         # one row for each of RANGES ranges
        histogram += np.array(row["histogram"])
        bitmap[row["range"] << (BITS - 3):(row["range"] + 1) << (BITS - 3)] = np.frombuffer(row["bits"], np.uint8)
    least = next(level for level in range(LEAST, 65) if histogram[level:].sum() <= HEAVY)
    found = sums.select("cells", "levels").mapInArrow(_above(least), "cells binary, levels binary").collect()
    cells = np.frombuffer(b"".join(bytes(x["cells"]) for x in found), np.uint32)
    levels = np.frombuffer(b"".join(bytes(x["levels"]) for x in found), np.uint8)
    order = np.argsort(cells, kind="stable")
    return bitmap, cells[order], levels[order]


def _describe(words: int, percent: int, shared):
    """For each text its node (a digest of its set), size, prefix shingles that may be shared, and then its set."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, order = WordHasher(space_words()), Order(*shared.value)
        for batch in batches:
            rows, held = [], 0
            ids, done = batch.column(0), 0
            for own in shingle_sets(hasher, batch.column(1), words):
                size = len(own)
                if size:
                    ranks = order.ranks(own)
                    prefix = size - -(-percent * size // 100) + 1
                    first = np.argsort(ranks, kind="stable")[:prefix]
                    places = np.flatnonzero(ranks[first] > 0)
                    raw = own.tobytes()
                    rows.append((hashlib.blake2b(raw, digest_size=16).digest(), size,
                                 own[first[places]].view(np.int64), places.astype(np.int32),
                                 raw if len(places) else None))
                    held += len(raw) if len(places) else 64
                else:
                    rows.append((None, 0, [], [], None))
                if held >= 1 << 23:
                    yield packed(ids.slice(done, len(rows)), rows)
                    done, rows, held = done + len(rows), [], 0
            if rows:
                yield packed(ids.slice(done, len(rows)), rows)

    def packed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        node, size, shingles, places, members = zip(*rows)
        return pa.record_batch({"_id": ids, "node": pa.array(node, pa.binary()), "n": pa.array(size, pa.int64()),
                                "shingles": pa.array(shingles, pa.list_(pa.int64())),
                                "places": pa.array(places, pa.list_(pa.int32())),
                                "members": pa.array(members, pa.binary())})
    return describe


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                parts = [np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=64) for s in (small, large)]
                if np.minimum(*parts).sum() < need:                     # suffix filter
                    linked.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                linked.append(int((large[at] == small).sum()) >= need)
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1), "linked": pa.array(linked, pa.bool_())})
    return verify


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / math.log(RATIO)).cast("int")


def _may_reach(percent: int, index: str, probe: str) -> Column:
    """Length and positional filter of two postings; the index side is the smaller set, ties broken by node."""
    n, m = F.col(f"{index}_n"), F.col(f"{probe}_n")
    left = F.least(n - F.col(f"{index}_pos"), m - F.col(f"{probe}_pos"))
    smaller = (n < m) | ((n == m) & (F.col(index) < F.col(probe)))
    return smaller & (100 * n >= percent * m) & ((100 + percent) * left >= percent * (n + m))


def linked_nodes(tables: Tables, sets: DataFrame, percent: int) -> DataFrame:
    """Components (see graph) of the nodes of ``sets``."""
    postings = sets.where("size(shingles) > 0").select(
        "node", "n", F.explode(F.arrays_zip("shingles", "places")).alias("_p")).select(
        F.col("_p.shingles").alias("shingle"), "node", "n", F.col("_p.places").cast("bigint").alias("pos"))
    postings = postings.dropDuplicates(["shingle", "node"])
    shared = postings.groupBy("shingle").agg(F.count("*").alias("_c")).where("_c > 1").select("shingle")
    postings = tables.replace("postings", postings.join(shared, "shingle"))
    # Tasks combine copies before they meet: a large group of equal sets is one row per task.
    members = sets.where("members is not null").groupBy("node").agg(F.first("members").alias("set"))
    members = tables.replace("members", members.join(postings.select("node").distinct(), "node", "left_semi"))

    reach = F.expr(f"n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + 1")
    index = postings.where(F.col("pos") < reach).withColumn("size_class", _size_class(F.col("n"))).select(
        "shingle", "size_class", F.col("node").alias("y"), F.col("n").alias("y_n"), F.col("pos").alias("y_pos"))
    least, most = F.expr(f"({percent} * n + 99) div 100"), F.expr(f"least(n, {100 + percent} * (n - pos) div {percent} - n)")
    probes = postings.withColumn("_least", least).withColumn("_most", most).where("_most >= _least").select(
        "shingle", F.explode(F.sequence(_size_class(F.col("_least")), _size_class(F.col("_most")))).alias("size_class"),
        F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"))
    index = tables.replace("index", index)
    groups = index.groupBy("shingle", "size_class").agg(F.min(F.struct("y_pos", "y_n", "y")).alias("_l"))
    probes = tables.replace("probes", probes.join(groups, ["shingle", "size_class"]).where("x != _l.y"))

    def verified(name: str, pairs: DataFrame) -> DataFrame:
        both = pairs.join(members.withColumnsRenamed({"node": "x", "set": "x_set"}), "x").join(
            members.withColumnsRenamed({"node": "y", "set": "y_set"}), "y")
        checked = both.select(F.col("x").alias("a"), F.col("y").alias("b"), "x_set", "y_set").mapInArrow(
            _verify(percent), "a binary, b binary, linked boolean")
        return tables.replace(name, checked)

    central = probes.select("x", "x_n", "x_pos", "_l.*").select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "x_n", "y_n", "x_pos", "y_pos")
    fits = F.expr(f"{100 + percent} * least(x_n - x_pos, y_n - y_pos) >= {percent} * (x_n + y_n)")
    first = verified("first", central.where(fits).select("x", "y").distinct())
    found = first.where("linked").select("a", "b")
    labels = components(tables, found)

    def labelled(df: DataFrame, node: str) -> DataFrame:
        own = labels.select(F.col("a").alias(node), F.col("b").alias(f"{node}_label"))
        return df.join(own, node, "left").withColumn(f"{node}_label", F.coalesce(f"{node}_label", node))

    # Of the rest only sets of different components are paired: first groups with components, then those with sets.
    index = tables.replace("labelled", labelled(index, "y"))
    parts = index.groupBy("shingle", "size_class", "y_label").agg(F.min("y_n").alias("y_least"))
    rest = labelled(probes.drop("_l"), "x").join(parts, ["shingle", "size_class"]).where("x_label != y_label").where(
        f"{100 + percent} * (x_n - x_pos) >= {percent} * (x_n + y_least)").drop("y_least")
    pairs = rest.join(index, ["shingle", "size_class", "y_label"]).where(_may_reach(percent, "y", "x"))
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = pairs.join(first.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
    second = verified("second", pairs)
    return components(tables, found.unionAll(second.where("linked").select("a", "b")))


def shingle_components(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                       words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links)."""
    tables = Tables(spark)
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    order = spark.sparkContext.broadcast(shingle_order(tables, texts.select("_text"), words))
    kind = texts.schema["_id"].dataType.simpleString()
    sets = tables.replace("sets", texts.select("_id", "_text").mapInArrow(
        _describe(words, percent, order),
        f"_id {kind}, node binary, n bigint, shingles array<bigint>, places array<int>, members binary"))
    order.unpersist()
    labels = linked_nodes(tables, sets, percent).select(F.col("a").alias("node"), F.col("b").alias("label"))
    nodes = sets.where("node is not null").groupBy("node").agg(F.min("_id").alias("_least"), F.count("*").alias("_copies"))
    nodes = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = nodes.groupBy("label").agg(F.min("_least").alias("component_id"))
    found = tables.replace("found", nodes.join(groups, "label").select("node", "component_id", "_copies"))
    empty = sets.where("node is null").select("_id", F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"))
    rows = sets.where("node is not null").select("_id", "node", F.col("n").alias("n_shingles"))
    return join_groups(rows, found, "node", "_copies").select("_id", "n_shingles", "component_id").unionAll(empty)


def one_of_each_group(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each group of linked ones the row with the smallest id (null first, then
    by a digest of the text) stays, and one of rows that agree in both.  Texts without words are linked with nothing
    and stay."""
    key = F.struct(F.col(id_column).alias("id"), F.md5(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("digest"))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"), F.col(text_column).alias("_text"))
    found = shingle_components(spark, keyed, "_key", "_text", words, percent)
    counted = found.groupBy("_id").agg(F.max(F.col("component_id") != F.col("_id")).alias("drop"), F.count("*").alias("_c"),
                                       F.max("n_shingles").alias("n"))
    notes = counted.where("drop or (_c > 1 and n > 0)").select(F.col("_id").alias("_key"), "drop")
    joined = keyed.drop("_text").join(notes, "_key", "left")
    repeated = joined.where("drop = false").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row")
    return joined.where("drop is null").select("_row").unionAll(repeated).select("_row.*")
