"""Zip archives of source files, read by a data source of their entries.

A plan lists the archives; small ones are read several to a partition, and of one larger than ``PARTITION`` bytes the
central directory alone is read to cut its entries into ranges, so no archive need fit into memory and a large one is
read by many tasks.  A suffix is an option of the source and is tested on names before any entry is unpacked.  What cannot be read is a row with an ``error``, an archive or a single entry; the rest is read all the same.

Files are opened through Arrow's file systems by tasks, so archives lie on storage that those reach (a shared folder,
HDFS, object stores); ``spark_archives`` reads whole archives through Spark's own reader from any other.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = "shard string, path string, data binary, error string"
_SCHEMA = pa.schema([("shard", pa.string()), ("path", pa.string()), ("data", pa.binary()), ("error", pa.string())])
PARTITION = 32 << 20          # bytes of archives that a partition reads
_ROWS, _BYTES = 256, 32 << 20
_UNREADABLE = (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError, ValueError)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; ``file:`` may be written with any number of slashes."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder.rstrip("/")))


def _shard(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _batches(rows: Iterable[tuple[str, str | None, bytes | None, str | None]]) -> Iterator[pa.RecordBatch]:
    """Rows in small batches, so memory holds one entry and one batch."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2] or b"")
        if len(held) >= _ROWS or size >= _BYTES:
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in held], schema=_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in held], schema=_SCHEMA)


def entries(source, shard: str, suffixes: list[str], first: int = 0, end: int | None = None) -> Iterator[tuple]:
    """Rows of an archive, or of a range of its entries; ``source`` is a seekable file."""
    try:
        archive = zipfile.ZipFile(source)
    except _UNREADABLE as error:
        if not first:
            yield shard, None, None, f"archive: {type(error).__name__}"
        return
    with archive:
        for entry in archive.infolist()[first:end]:
            if entry.is_dir() or not all(entry.filename.endswith(s) for s in suffixes):
                continue
            try:
                yield shard, entry.filename, archive.read(entry), None
            except _UNREADABLE as error:
                yield shard, entry.filename, None, f"entry: {type(error).__name__}"


class _Part(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int | None]]):
        self.ranges = ranges


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self._folder = options["path"]
        self._suffixes = [options["suffix"]] if options.get("suffix") else []

    def partitions(self) -> list[_Part]:
        system, root = opened(self._folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        parts, held, size = [], [], 0
        for info in sorted((f for f in found if f.is_file and f.path.lower().endswith(".zip")), key=lambda f: f.path):
            if info.size > PARTITION:
                parts += [_Part([(info.path, a, b)]) for a, b in self._ranges(system, info.path)]
                continue
            held.append((info.path, 0, None))
            size += info.size
            if size >= PARTITION:
                parts.append(_Part(held))
                held, size = [], 0
        return parts + ([_Part(held)] if held or not parts else [])

    @staticmethod
    def _ranges(system: fs.FileSystem, path: str) -> Iterator[tuple[int, int | None]]:
        """Entries of about ``PARTITION`` packed bytes."""
        try:
            with system.open_input_file(path) as source, zipfile.ZipFile(source) as archive:
                sizes = [entry.compress_size for entry in archive.infolist()]
        except _UNREADABLE:
            yield 0, None                                # the task tells why
            return
        first, held = 0, 0
        for number, size in enumerate(sizes):
            held += size
            if held >= PARTITION:
                yield first, number + 1
                first, held = number + 1, 0
        if first < len(sizes) or not sizes:
            yield first, None

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self._folder)

        def rows() -> Iterator[tuple]:
            for path, first, end in partition.ranges:
                try:
                    source = system.open_input_file(path)
                except OSError as error:
                    yield _shard(path), None, None, f"archive: {type(error).__name__}"
                    continue
                with source:
                    yield from entries(source, _shard(path), self._suffixes, first, end)
        yield from _batches(rows())


class ZipEntries(DataSource):
    """``spark.read.format("zip_entries").option("suffix", ".java").load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(dict(self.options))


def scan_archives(spark: SparkSession, folder: str, suffix: str | None = None) -> DataFrame:
    """(shard, path, data, error): the entries of every ``.zip`` below the folder, whatever the case of its suffix, and a row with
    an error for each archive (without a path) and entry that cannot be read."""
    spark.dataSource.register(ZipEntries)
    reader = spark.read.format("zip_entries")
    return (reader.option("suffix", suffix) if suffix else reader).load(folder)


def read_archives(spark: SparkSession, folder: str, suffix: str | None = None) -> DataFrame:
    """(shard, path, data): the entries that can be read.

    ``data`` holds the bytes, so the caller decides about malformed text: ``content_of`` or filters.readable.
    """
    return scan_archives(spark, folder, suffix).where("error IS NULL").drop("error")


def _unzip(suffix: str | None):
    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                yield from _batches(entries(io.BytesIO(memoryview(content.as_buffer())), _shard(path.as_py()), [suffix] if suffix else []))
    return unzip


def spark_archives(spark: SparkSession, folder: str, suffix: str | None = None) -> DataFrame:
    """The same rows from any storage that Spark reads, which leaves out empty files; a task holds a whole archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(_unzip(suffix), ENTRY)


def content_of(rows: DataFrame) -> DataFrame:
    """Bytes to text; malformed bytes are replaced."""
    return rows.withColumn("content", F.make_valid_utf8(F.col("data").cast("string"))).drop("data")


# --- Writing ------------------------------------------------------------------------------------------------------------
def _zip_to(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root)
        name, archive, target, held, own = None, None, None, 0, ""

        def close() -> pa.RecordBatch:
            archive.close()
            target.close()
            system.move(own, f"{root}/{name}.zip")       # a repeated task replaces the archive by an equal one
            return pa.record_batch({"shard": pa.array([name]), "entries": pa.array([held], pa.int64())})

        for batch in batches:
            for shard, path, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "data"))):
                if shard != name:
                    if archive:
                        yield close()
                    name, held, own = shard, 0, f"{root}/.{shard}-{uuid.uuid4().hex}"
                    target = system.open_output_stream(own)
                    archive = zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(path), data, zipfile.ZIP_DEFLATED)
                held += 1
        if archive:
            yield close()
    return run


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write (shard, path, data) as one archive per shard and return (shard, entries).  A shard is written by one task, entry by
    entry, so shards are cut to a number of rows first (sharding.assign_shards)."""
    sorted_rows = rows.select("shard", "path", "data").repartition("shard").sortWithinPartitions("shard", "path")
    written = sorted_rows.mapInArrow(_zip_to(folder), "shard string, entries bigint")
    return written.sparkSession.createDataFrame(written.collect(), written.schema)       # one row per archive


def _store_to(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        for batch in batches:
            for name, data in zip(*(batch.column(c).to_pylist() for c in ("name", "data"))):
                parent, own = f"{root}/{name}".rsplit("/", 1)
                system.create_dir(parent)
                hidden = f"{parent}/.{own}-{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as target:
                    target.write(data)
                system.move(hidden, f"{parent}/{own}")           # a repeated task replaces the file by an equal one
            yield pa.record_batch({"files": pa.array([batch.num_rows], pa.int64())})
    return run


def write_files(rows: DataFrame, folder: str) -> int:
    """Write (name, data) as a file each; how many."""
    return rows.select("name", "data").mapInArrow(_store_to(folder), "files bigint").agg(F.sum("files")).first()[0] or 0
