from pyspark.sql import functions as F

from tokenloom.operators import ranking, stats
from tokenloom.plans import catalog, pipeline
from tokenloom.sources import tables
from tokenloom.streaming import ingest

from conftest import SMALL


def java(spark):
    return tables.java_files(tables.read_table(spark, SMALL, "documents"))


def test_ingest_equals_batch_and_takes_each_file_once(spark, tmp_path):
    """Folders by shard, as the sinks write them: shards survive, and each batch is what the batch steps make of it."""
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    files = java(spark).withColumn("shard", F.concat("shard", F.lit(" +%/é")))
    files.where("file_id % 2 = 0").repartition(3).write.partitionBy("shard").parquet(f"{source}/a")
    ingest.ingest(spark, source, out, progress, files_per_trigger=9).awaitTermination()
    files.where("file_id % 2 = 1").repartition(2).write.partitionBy("shard").parquet(f"{source}/b")
    for _ in range(2):
        ingest.ingest(spark, source, out, progress).awaitTermination()
    got = spark.read.parquet(out).select("file_id", "shard", "path", "unicode")
    batch = pipeline.encoded_files(pipeline.cleaned_files(files)).select("file_id", "shard", "path", "unicode")
    assert got.count() == batch.count() > 0
    assert got.where("shard is null").count() == 0
    assert got.exceptAll(batch).count() == 0


def test_a_part_file_of_one_row_group_is_taken_by_all_cores(spark, tmp_path):
    source, out = str(tmp_path / "in"), tmp_path / "out"
    files = java(spark)
    files.coalesce(1).write.parquet(f"{source}/a")
    ingest.ingest(spark, source, str(out), str(tmp_path / "progress")).awaitTermination()
    tasks = {p.name.split("-")[1] for p in out.rglob("part-*.parquet")}
    assert len(tasks) == spark.sparkContext.defaultParallelism
    got = spark.read.parquet(str(out)).select("file_id", "shard", "path", "unicode")
    batch = pipeline.encoded_files(pipeline.cleaned_files(files)).select("file_id", "shard", "path", "unicode")
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch).count() == 0


def test_streams_of_a_table_that_is_a_folder(spark, tmp_path):
    documents = tables.read_table(spark, SMALL, "documents")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    empty = tmp_path / "empty"
    documents.limit(0).write.parquet(str(empty / "documents.parquet"))
    for name in ("streamed_category_counts", "streamed_frequencies"):
        query = catalog.queries()[name]
        whole, parts = query(spark, SMALL), query(spark, str(tmp_path))
        assert whole.count() == parts.count() > 0
        assert whole.exceptAll(parts).count() == 0
        assert query(spark, str(empty)).count() == 0


def test_running_totals_equal_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    files = java(spark)
    files.repartition(3).write.parquet(f"{source}/a")
    cases = [(ingest.running_categories, stats.category_counts(files), ["category", "n"]),
             (ingest.running_frequencies, ranking.frequencies(ranking.values(files)), ["kind", "item", "cnt"])]
    for i, (running, batch, columns) in enumerate(cases):
        seen = {}
        keep = lambda df, _: seen.update({tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()})
        stream = running(ingest.new_files(spark, source, 1))
        ingest.start_totals(stream, str(tmp_path / f"progress{i}"), keep, "update").awaitTermination()
        assert seen == {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in batch.collect()}
