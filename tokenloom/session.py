"""Session helpers shared by jobs and tests."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: For tables whose rows have megabytes.  By default pages and row groups are looked at after a hundred rows first, and writers,
#: readers and codecs keep buffers as large as the largest page, outside the heap.
LARGE_ROWS = {"parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.block.row.count.limit": "4",
              "parquet.enable.dictionary": "false"}
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(app: str = "tokenloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; on a local master without one, a fresh temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def small_batches(spark: SparkSession, size: str = "1m") -> Iterator[None]:
    """Jobs that run inside send about so many bytes to Python at a time, or one row.  By default these are 64 MB, for which a
    task has buffers of twice as much outside the heap, and the worker the strings and a result of up to three times as much.
    Buffers of up to 4 MB are pooled; larger ones leave gaps outside the heap, and that memory grows from task to task."""
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_BYTES)
        else:
            spark.conf.set(ARROW_BYTES, before)


class Tables:
    """Intermediate tables of an iterative job, written to the shared folder: they cut lineage and survive the loss
    of executors.  Each name alternates between two places, so a table may be replaced by one computed from it and
    the space used does not grow with the number of rounds."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self._turn: dict[str, int] = {}

    def folder(self, name: str) -> str:
        return f"{self._folder}/{name}"

    def replace(self, name: str, df: DataFrame, by: str | None = None, large_rows: bool = False) -> DataFrame:
        """Write the table, with a folder for each value of ``by`` if given, and read it again."""
        turn = self._turn[name] = 1 - self._turn.get(name, 1)
        path = f"{self._folder}/{name}-{turn}"
        writer = df.write.mode("overwrite").partitionBy(*([by] if by else []))
        with small_batches(self._spark):
            writer.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove one of them."""
        for turn in (0, 1):
            self._remove(f"{self._folder}/{name}-{turn}")
        self._turn.pop(name, None)

    def delete(self) -> None:
        """Remove all of them; for jobs whose result does not read them any more."""
        self._remove(self._folder)

    def _remove(self, folder: str) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
