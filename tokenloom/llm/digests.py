"""Exact dedup (3): a persistent index of text digests, bucketed and sorted by digest.

New rows are reduced to one row per digest (their largest id), joined to the index by a sort-merge anti-join that reads
the index by bucket without shuffling it, and what is new is appended.  An interrupted ``add`` may be repeated: what has
been appended is found in the index.  Only digests and ids move between tasks, never texts.

The index is a folder of generations, each with its number of buckets in its name.  When a bucket would hold more than
``PER_BUCKET`` digests, or has ``FILES`` files, the next generation is written from the last one, with more buckets or
with one sorted file each; it counts once it is complete, and then the one before goes.  One writer at a time.

Defined cases: a null text counts as empty; A-Z alone are lower-cased; of equal texts in one batch the largest id stays,
and a text of an earlier batch stays before any later one; rows that repeat an id and a text share the mark; null ids
are smaller than others, and a group of null ids alone keeps null; extra columns are ignored; an empty table adds nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.skew import join_groups
from tokenloom.session import Tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PER_BUCKET = 1 << 22        # digests of a bucket, some 200 MB
FILES = 8                   # files of a bucket before they are made one


def text_digest(text: Column) -> Column:
    """SHA-256 of the lower-cased text in UTF-8, as lower-case hex."""
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER).cast("binary"), 256)


class DigestIndex:
    """The index in a folder that all executors share; opening the same folder again continues it.  ``buckets`` is the
    number that a new index begins with."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", buckets: int = 64):
        self._spark, self._folder, self._id_type = spark, folder, id_type
        complete = [name for name in self._generations() if self._exists(f"{folder}/{name}/_SUCCESS")]
        self._open(complete[-1] if complete else f"{0:06d}-{buckets}")

    def _path(self, name: str):
        path = self._spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, system = self._path(name)
        return system.exists(path)

    def _generations(self) -> list[str]:
        path, system = self._path(self._folder)
        return sorted(x.getPath().getName() for x in system.listStatus(path)) if system.exists(path) else []

    def _remove(self, name: str) -> None:
        path, system = self._path(name)
        system.delete(path, True)

    def _open(self, generation: str) -> None:
        self._generation, self.buckets = generation, int(generation.split("-")[1])
        place = f"{self._folder}/{generation}"
        self.table = f"digest_index_{hashlib.md5(place.encode()).hexdigest()}"
        self._spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {self._id_type}) USING parquet "
                        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def rows(self) -> DataFrame:
        return self._spark.table(self.table)

    def add(self, groups: DataFrame) -> None:
        """Append the groups (``digest``, ``keep_id``) whose digest is not in the index."""
        new = groups.select("digest", "keep_id").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._append(new)

    def make_room(self, more: int) -> None:
        """Enough buckets for ``more`` further digests, and few files in each."""
        buckets, total = self.buckets, self.rows().count() + more
        while total > buckets * PER_BUCKET:
            buckets *= 2
        if buckets > self.buckets or len(self.rows().inputFiles()) >= FILES * buckets:
            self._rewrite(buckets)

    def _append(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)

    def _rewrite(self, buckets: int) -> None:
        """The next generation, from the rows of this one; what an interrupted attempt left is replaced."""
        rows, table, before = self.rows(), self.table, self._generation
        number = int(before.split("-")[0]) + 1
        for stale in self._generations():
            if int(stale.split("-")[0]) >= number:
                self._remove(f"{self._folder}/{stale}")
        self._open(f"{number:06d}-{buckets}")
        self._append(rows)
        self._spark.sql(f"DROP TABLE {table}")
        self._remove(f"{self._folder}/{before}")

    def delete(self) -> None:
        """Remove the index, in the catalog and in its folder."""
        self._spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._remove(self._folder)


def mark_copies(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``keep_id``, ``group_size`` (in this batch), ``kept``, ``text_sha256``.

    Without an ``index`` the batch has one of its own, which goes when the marks are found."""
    tables = Tables(spark)
    ids = docs.schema[id_column].dataType.simpleString()
    rows = tables.replace("digests", docs.select(
        F.col(id_column).alias("_id"), F.unhex(text_digest(F.col(text_column))).alias("digest")))
    groups = tables.replace("groups", rows.groupBy("digest").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")))
    own = index or DigestIndex(spark, tables.folder("index"), ids)
    own.make_room(groups.count())
    own.add(groups)
    stays = tables.replace("stays", groups.drop("keep_id").join(own.rows().hint("merge"), "digest"))
    if index is None:
        own.delete()
    return join_groups(rows, stays, "digest", "group_size").select(
        "_id", "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
