"""The batch steps on a stream of newly arriving files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tokenloom.operators import ranking
from tokenloom.plans import pipeline
from tokenloom.sources.tables import SOURCE_FILES

RANGES_PER_CORE = 4          # a batch with as many ranges of files is not spread


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder of part files, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    parent, name = path.rstrip("/").rsplit("/", 1)
    parts = spark.read.parquet(path).select("_metadata.file_path").limit(1).collect()
    if parts and parts[0][0].rstrip("/").endswith(f"/{name}"):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)
    return spark.readStream.schema(schema).parquet(path)


def new_files(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Source files as they arrive in the sub-folders of ``folder``, each file once.  A shard that is a folder
    (``shard=name``) and not a column comes from the file's path."""
    reader = spark.readStream.schema(SOURCE_FILES).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    named = F.regexp_extract(F.col("_metadata.file_path"), r"/shard=([^/]*)/[^/]*$", 1)
    for _ in range(2):                                  # once for the path, once for the folder's name
        named = F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B")))
    shard = F.coalesce("shard", F.when(named != "__HIVE_DEFAULT_PARTITION__", F.nullif(named, F.lit(""))))
    return reader.parquet(folder).withColumn("shard", shard)


def spread_batch(batch: DataFrame) -> DataFrame:
    """The rows of a batch over all cores, as many parts for each.  A part file is cut into ranges, but all rows of a row group
    are read with one of them, so there may be far fewer tasks with rows than partitions.  Only a batch with several ranges
    of full size for each core is left alone."""
    cores, ranges = batch.sparkSession.sparkContext.defaultParallelism, batch.rdd.getNumPartitions()
    waves = max(1, -(-ranges // cores))
    return batch if ranges >= RANGES_PER_CORE * cores else batch.repartition(waves * cores, "file_id", "path")


def ingest(spark: SparkSession, folder: str, output: str, checkpoint: str, files_per_trigger: int | None = None,
           batches: int | None = None) -> StreamingQuery:
    """Clean and encode what is new in ``folder`` by the batch functions and write it to ``output``, then stop, at the latest
    after so many ``batches``; another call with the same checkpoint goes on from there.

    Every file is taken once.  A batch is a folder of its own, so one that is repeated after a failure replaces itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        encoded = pipeline.encoded_files(pipeline.cleaned_files(spread_batch(batch)))
        encoded.write.mode("overwrite").partitionBy("shard").parquet(f"{output}/batch={number}")

    writer = new_files(spark, folder, files_per_trigger).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if batches is None:
        return writer.trigger(availableNow=True).start()
    query = writer.start()
    while query.isActive and not _done(query, batches):
        time.sleep(0.05)
    query.stop()                            # a batch under way is repeated by the next call
    return query


def _done(query: StreamingQuery, batches: int) -> bool:
    last, status = query.lastProgress, query.status
    return bool(last) and (last["batchId"] + 1 >= batches or not (status["isDataAvailable"] or status["isTriggerActive"]))


def running_categories(files: DataFrame) -> DataFrame:
    """(category, n) so far; at most as many groups as there are categories, so the state stays small."""
    from tokenloom.operators.stats import measured as measure
    measured = measure(files)
    parts = F.array(F.struct(F.lit("EOL").alias("category"), F.col("ends").cast("bigint").alias("n")),
                    F.struct(F.lit("WHITESPACE_NO_EOL").alias("category"), F.col("blanks").cast("bigint").alias("n")))
    other = F.array(F.struct(F.col("category"), F.lit(1).cast("bigint").alias("n")))
    rows = measured.select(F.explode(F.when(F.col("category") == "WHITESPACE", parts).otherwise(other)).alias("r"))
    return rows.where(F.col("r.n") > 0).groupBy(F.col("r.category").alias("category")).agg(F.sum("r.n").alias("n"))


def running_frequencies(files: DataFrame) -> DataFrame:
    """(kind, item, cnt) so far."""
    return ranking.frequencies(ranking.values(files))


def start_totals(totals: DataFrame, checkpoint: str, on_batch, mode: str = "update") -> StreamingQuery:
    """Run a totals stream over all that is available; ``on_batch(df, batch_id)`` gets the changed (``update``) or
    all (``complete``) totals."""
    return (totals.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(on_batch)
            .trigger(availableNow=True).start())


def changes_to(path: str):
    """For ``start_totals``: a batch writes the totals that it changed and no others, into a folder of its own."""
    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write


def latest(spark: SparkSession, path: str, totals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The totals so far: of each key what the last batch that changed it wrote.  ``totals`` gives the columns."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):         # no batch yet
        return spark.createDataFrame([], totals.schema)
    columns = totals.columns
    changes = spark.read.schema(StructType([*totals.schema.fields, StructField("batch", LongType())])).parquet(path)
    return changes.groupBy(*keys).agg(F.max_by(value, "batch").alias(value)).select(*columns)
