"""Merkle manifest of a dataset (12): one root digest for all rows, and for every row a proof of membership.

A row's leaf hashes all its fields.  The leaves of a group, in order of their id, are the lowest level of a tree; each run of
``arity`` consecutive nodes becomes one node above, and the group's last node is its subroot.  The subroots, in order of
their group, are the leaves of one more tree, which ends in the root.  Levels are tables of nodes with their place: a level
is joined to itself on computed places (the place with its last bit flipped for two to a run, else the run's other slots by
their offset), which gives every node its siblings, and the rows in slot zero emit the parents.  Proofs go down the same
tables: each node's path is its own siblings followed by its parent's path, joined by the parent's place.

Every key of a join is a single node, and a node has at most ``arity`` children, so no group is too large.  Places come from one
range partition of ids and digests by group and id; only totals per range and group meet.  Texts are read once and never move.

Defined cases: a null group is a group, the first one; null ids come first in their group; equal ids are ordered by their
leaf, and rows equal in all fields may swap places, which changes no digest; a group of one row has its leaf as subroot, and with
one group the subroot is the root; long texts are hashed whole; extra columns are ignored, also those with clashing
names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.session import Tables

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:binary,right:binary>>"


def digest(*inputs: Column) -> Column:
    """SHA-256 of the concatenated strings."""
    return F.unhex(F.sha2(F.concat(*inputs).cast("binary"), 256))


def hexed(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def framed(value: Column) -> Column:
    """A field with its length in bytes in front, so that no two rows of fields have the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return digest(*(framed(v) for v in values))


def _places(tables: Tables, name: str, rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place`` and ``width``: a row's number in its ``tree`` and the number of rows there."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = tables.replace(f"{name}-ranged", ranged.withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftrightunsigned("_at", 33))
    inside = Window.partitionBy("tree")                        # a row per range: few, however large a tree
    runs = ranged.groupBy("_range", "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(inside.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    runs = tables.replace(f"{name}-runs", runs.select(
        "_range", "tree", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(inside).alias("width")))
    joined = ranged.join(runs, ["_range", "tree"])             # its size is known, so it is broadcast only if it is small
    return joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add ``left`` and ``right``: the digests of the run's other nodes before and after each node."""
    slot = F.col("place") % arity
    joined, others = nodes, []
    for offset in range(1, arity):
        there = F.col("place").bitwiseXOR(F.lit(1).cast("bigint")) if arity == 2 else F.col("place") - slot + (slot + offset) % arity
        sibling = nodes.select("tree", F.col("place").alias("_there"), F.col("digest").alias(f"_d{offset}"))
        joined = joined.withColumn("_there", there).join(sibling, ["tree", "_there"], "left").drop("_there")
        others.append(F.struct(((slot + offset) % arity).alias("slot"), F.col(f"_d{offset}").alias("digest")))
    run = F.array_sort(F.filter(F.array(*others), lambda x: x["digest"].isNotNull()))

    def side(keep) -> Column:
        return F.aggregate(F.filter(run, keep), F.unhex(F.lit("")), lambda held, x: F.concat(held, x["digest"]))
    if arity == 2:
        own, none = F.col("_d1"), F.unhex(F.lit(""))
        left, right = (F.when((slot == k) & own.isNotNull(), own).otherwise(none) for k in (1, 0))
    else:
        left, right = side(lambda x: x["slot"] < slot), side(lambda x: x["slot"] > slot)
    return joined.withColumns({"left": left, "right": right}).drop(*(f"_d{o}" for o in range(1, arity)))


def above(left: Column, own: Column, right: Column) -> Column:
    """The parent's digest from a run's three parts."""
    return digest(hexed(left), hexed(own), hexed(right))


@dataclass
class Forest:
    """The levels of some trees from the leaves up (``tree``, ``place``, ``digest``, ``width``, ``left``, ``right``; the lowest also
    has the leaves' own columns), the trees of a single leaf, and all tops (``tree``, ``digest``, ``height``)."""

    levels: list[DataFrame]
    single: DataFrame
    tops: DataFrame


def _forest(tables: Tables, name: str, leaves: DataFrame, arity: int) -> Forest:
    widest = leaves.agg(F.max("width")).first()[0] or 0
    single = leaves.where(F.col("width") == 1)
    nodes, levels = leaves.where(F.col("width") > 1), []
    tops = [single.select("tree", "digest", F.lit(0).alias("height"))]
    while widest > 1:
        level = tables.replace(f"{name}-{len(levels)}", _with_siblings(nodes, arity))
        levels.append(level)
        parents = level.where(F.col("place") % arity == 0).select(
            "tree", F.expr(f"place div {arity}").alias("place"), above(F.col("left"), F.col("digest"), F.col("right")).alias("digest"),
            F.expr(f"(width + {arity - 1}) div {arity}").alias("width"))
        tops.append(parents.where("width = 1").select("tree", "digest", F.lit(len(levels)).alias("height")))
        nodes, widest = parents.where("width > 1"), -(-widest // arity)
    return Forest(levels, single, tables.replace(f"{name}-tops", reduce(DataFrame.unionAll, tops)))


def _paths(tables: Tables, name: str, forest: Forest, tops: DataFrame, kept: list[str], arity: int) -> DataFrame:
    """For each leaf its ``path`` to what ``tops`` (``tree``, ``height``, ``path``, and columns ``kept`` for all leaves of the tree)
    begin with, lowest level first, beside the leaf's own columns."""
    reached = None
    for number in range(len(forest.levels) - 1, -1, -1):
        level = forest.levels[number].withColumn("_up", F.expr(f"place div {arity}"))
        own = tops.where(F.col("height") == number + 1).select("tree", F.lit(0).cast("bigint").alias("_up"), "path", *kept)
        parents = own if reached is None else own.unionByName(reached.select("tree", F.col("place").alias("_up"), "path", *kept))
        joined = level.join(parents.withColumnRenamed("path", "_path"), ["tree", "_up"])
        path = F.concat(F.array(F.struct("left", "right")).cast(_PATH), F.col("_path"))
        reached = joined.withColumn("path", path).drop("_up", "_path", "left", "right", "width")
        if number:
            reached = tables.replace(f"{name}-paths", reached.drop("digest"))
    own = forest.single.drop("width").join(tops.where("height = 0").drop("height"), "tree")
    return own if reached is None else reached.unionByName(own)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda held, step: above(step["left"], held, step["right"]))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on the path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(hexed(step["left"]), hexed(step["right"]))), ""))


def manifest(spark: SparkSession, rows: DataFrame, arity: int = 2) -> DataFrame:
    """``rows`` has ``_id``, ``group`` (a string) and ``digest`` (the leaf's), and any other columns, which are kept.

    Adds ``subroot``, ``root`` and ``path``, an array from the leaf up of the digests to the left and to the right.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    tables = Tables(spark)
    tree = F.coalesce(F.concat(F.lit("v"), F.col("group")), F.lit("-"))         # sorts as groups do, null first
    leaves = tables.replace("leaves", rows.withColumn("tree", tree))             # texts are read once
    lower = _forest(tables, "rows", _places(tables, "rows", leaves, ["_id", "digest"]), arity)
    groups = lower.tops.select(F.lit("").alias("tree"), F.col("tree").alias("_own"), "digest", F.col("height").alias("_height"))
    upper = _forest(tables, "groups", _places(tables, "groups", groups, ["_own"]), arity)
    last = upper.tops.first()                                                     # one tree, one row
    start = upper.tops.select("tree", "height", F.array().cast(_PATH).alias("path"))
    of_groups = tables.replace("of-groups", _paths(tables, "groups", upper, start, [], arity).select(
        F.col("_own").alias("tree"), F.col("_height").alias("height"), "path", F.col("digest").alias("subroot")))
    found = _paths(tables, "rows", lower, of_groups, ["subroot"], arity)
    root = F.unhex(F.lit(bytes(last["digest"]).hex())) if last else F.lit(None).cast("binary")
    return found.withColumn("root", root).drop("tree", "place")


def tampered_leaves(docs: DataFrame) -> DataFrame:
    """The rows of ``documents`` as leaves, and beside each the leaf of a copy whose length may have been changed by one."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    longer = F.when(chosen, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    changed = [longer if name == "n_chars" else F.col(name) for name in FIELDS]
    return docs.select(F.col("doc_id").alias("_id"), F.col("lang").cast("string").alias("group"),
                       leaf_digest([F.col(name) for name in FIELDS]).alias("digest"), leaf_digest(changed).alias("found"))


def verified(members: DataFrame) -> DataFrame:
    """Whether each leaf ``found`` leads to the root over the siblings of the original."""
    out = members.select(
        F.col("_id").alias("doc_id"), hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"), hexed(proof_digest(F.col("path"))).alias("proof_sha256"),
        hexed(folded(F.col("found"), F.col("path"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
