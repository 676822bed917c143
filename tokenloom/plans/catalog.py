"""The registered queries: each operator over the given tables.

Three corpora feed them: ``documents`` as they are, ``pages`` (markup, the harder input for the lexer), and Java files
made by Spark from ``documents`` for the operators that need declarations, comments, annotations and literals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import codec as cd
from tokenloom.functions import text as tx
from tokenloom.operators import (bpe, cleaning, compare, corpus, examples, filters, ranking, sharding, stats,
                                 vocabulary)
from tokenloom.operators import tokens as tk
from tokenloom.plans import pipeline, progress
from tokenloom.plans.settings import (BATCH, EXTRA_IDS, MAX_LENGTH, MERGES, REPORT_EVERY, SAMPLE_MERGES, SAMPLE_PERCENT, SHARD_ROWS,
                                      STREAM_FILES, SWEEP, TOP, TRAIN_RATIO)
from tokenloom.session import Tables
from tokenloom.sources import archives, sinks, textfiles
from tokenloom.sources import tables as tb
from tokenloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_MODELS: dict[tuple, bpe.BpeModel] = {}


def files(spark: SparkSession, folder: str) -> DataFrame:
    return tb.from_documents(tb.read_table(spark, folder, "documents"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The same for work on the texts themselves."""
    return tb.from_documents(tb.spread(tb.read_table(spark, folder, "documents")))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return tb.from_pages(tb.spread(tb.read_table(spark, folder, "pages")))


def java(spark: SparkSession, folder: str) -> DataFrame:
    return tb.java_files(tb.spread(tb.read_table(spark, folder, "documents")))


def over(source: Callable[[SparkSession, str], DataFrame]):
    """Register ``fn(files)`` under its name, fed from one of the corpora."""
    def register(fn: Callable[[DataFrame], DataFrame]):
        _QUERIES[fn.__name__] = lambda spark, folder: fn(source(spark, folder))
        return fn
    return register


def model_for(spark: SparkSession, folder: str, encoded: DataFrame, merges: int) -> bpe.BpeModel:
    """Learn once per session and state of the documents: several queries apply the same vocabulary."""
    parts = tb.read_table(spark, folder, "documents").select("_metadata.file_path", "_metadata.file_modification_time").distinct()
    state = parts.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_modification_time").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, folder, merges, *state)
    if key not in _MODELS:
        words = bpe.words_of(pipeline.unicode_lines(encoded))
        _MODELS[key] = bpe.train(words, len(bpe.SPECIAL_TOKENS) + cd.BASE_SIZE + merges)
    return _MODELS[key]


def with_model(merges: int = MERGES):
    """Register ``fn(encoded files, model)`` under its name."""
    def register(fn: Callable[[DataFrame, bpe.BpeModel], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            encoded = Tables(spark).replace("encoded", pipeline.encoded_files(texts(spark, folder)))     # read several times
            return fn(encoded, model_for(spark, folder, encoded, merges))
        _QUERIES[fn.__name__] = run
        return fn
    return register


def spaced(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


# --- Sources, files, names, shards ---------------------------------------------------------------------------------
@over(files)
def scan_source_files(df):
    return df.select("file_id", "path", "content")


@over(files)
def suffix_filter(df):
    return filters.with_suffix(df, ".java").select("file_id", "path")


@over(files)
def file_names(df):
    return filters.named_files(df).select("file_id", "file_name")


@over(files)
def hash_name_filter(df):
    return filters.drop_hash_names(filters.named_files(df)).select("file_id", "file_name")


@over(files)
def encoded_paths(df):
    return df.select("file_id", tx.encoded_path(F.col("shard"), F.col("path")).alias("file_path"))


@over(files)
def shard_assignment(df):
    return sharding.assign_shards(df.select("file_id"), SHARD_ROWS)


@over(files)
def shard_count(df):
    return sharding.shard_count(df, SHARD_ROWS)


@over(files)
def files_per_shard(df):
    return sharding.files_per_shard(df)


@over(files)
def shard_ranks(df):
    return sharding.shard_ranks(df)


@over(files)
def sample_shards(df):
    return sharding.sample_shards(df, SAMPLE_PERCENT).select("file_id", "shard")


@over(files)
def training_files(df):
    return sharding.training_files(df, TRAIN_RATIO).select("file_id", "shard")


@over(files)
def evaluation_files(df):
    return sharding.evaluation_files(df, TRAIN_RATIO).select("file_id", "shard")


@over(files)
def split_overlap(df):
    """Shards for training, for evaluation, and on both sides: none."""
    training = sharding.training_files(df, TRAIN_RATIO).select("shard", F.lit(1).alias("t"), F.lit(0).alias("e"))
    evaluation = sharding.evaluation_files(df, TRAIN_RATIO).select("shard", F.lit(0).alias("t"), F.lit(1).alias("e"))
    sides = training.unionByName(evaluation).groupBy("shard").agg(F.max("t").alias("t"), F.max("e").alias("e"))
    return sides.agg(F.sum("t").alias("training"), F.sum("e").alias("evaluation"), F.sum(F.col("t") * F.col("e")).alias("shared"))


@over(files)
def count_first_folders(df):
    return sharding.count_training_files(df, 0.9)


@over(files)
def count_training_files(df):
    return sharding.count_training_files(df, TRAIN_RATIO, ".txt")


@over(files)
def training_steps(df):
    return sharding.training_steps(df, TRAIN_RATIO, batch=BATCH // 4, accumulation=4)


@over(files)
def processed_files(df):
    return sinks.with_checksum(sinks.processed_names(df)).select("file_id", "shard", "size")


# --- Text ------------------------------------------------------------------------------------------------------------
@over(java)
def normalize_newlines(df):
    return cleaning.normalize(df).select("file_id", "content")


@over(java)
def strip_header(df):
    return df.transform(cleaning.normalize).transform(cleaning.strip_headers).select("file_id", "content")


@over(texts)
def corpus_lines(df):
    return corpus.lines(df)


@over(texts)
def corpus_text(df):
    return corpus.joined(df).select("file_id", "content")


@over(texts)
def non_blank_files(df):
    """Every eleventh text is blanked, so that there is something to drop."""
    df = df.withColumn("content", F.when(F.col("file_id") % 11 == 0, " \n\t").otherwise(F.col("content")))
    return filters.drop_empty(df).select("file_id", "content")


@over(texts)
def line_counts(df):
    return corpus.line_counts(corpus.lines(df))


@over(texts)
def fill_in_the_middle(df):
    return corpus.fill_in_the_middle(df).select("file_id", "content")


# --- Tokens ----------------------------------------------------------------------------------------------------------
@over(java)
def lex_tokens(df):
    return tk.tokens(df)


@over(pages)
def lex_markup(df):
    return tk.tokens(df).groupBy("token_type", "text").agg(F.count("*").alias("n"))


@over(java)
def token_categories(df):
    return tk.categories(tk.tokens(df)).select("file_id", "pos", "category")


@over(pages)
def significant_tokens(df):
    return tk.significant(tk.tokens(df), keep_newlines=True)


@over(java)
def token_line_numbers(df):
    return tk.line_numbers(tk.tokens(df, ordered=True)).select("file_id", "pos", "line_no")


@over(java)
def neighbour_types(df):
    return tk.neighbours(tk.tokens(df, ordered=True)).select("file_id", "pos", "previous_type", "next_type")


@over(java)
def bracket_balance(df):
    return tk.balance(tk.tokens(df, ordered=True))


@over(java)
def retokenize(df):
    return tk.retokenized(df).select("file_id", "content")


# --- Cleaning and garbage --------------------------------------------------------------------------------------------
@over(java)
def strip_comments(df):
    return cleaning.strip_comments(df).select("file_id", "content")


@over(java)
def format_files(df):
    return cleaning.format_files(df).select("file_id", "content")


@over(java)
def remove_annotations(df):
    return cleaning.remove_annotations(df).select("file_id", "content")


@over(java)
def clean_files(df):
    return cleaning.clean(df).select("file_id", "content")


@over(java)
def declared_files(df):
    return filters.drop_undeclared(df).select("file_id")


@over(java)
def balanced_files(df):
    return filters.drop_unbalanced(df).select("file_id")


@over(java)
def garbage_filter(df):
    return filters.drop_garbage(df).select("file_id")


@over(java)
def dataset_size(df):
    return stats.dataset_size(filters.drop_garbage(df))


# --- Statistics and rankings -----------------------------------------------------------------------------------------
@over(java)
def file_token_stats(df):
    return stats.file_stats(df)


@over(pages)
def corpus_token_stats(df):
    return stats.corpus_stats(df)


@over(java)
def merged_token_stats(df):
    return stats.merged_stats(stats.file_stats(df))


@over(java)
def token_stats_report(df):
    return stats.report(stats.corpus_stats(df))


@over(java)
def category_counts(df):
    return stats.category_counts(df)


@over(java)
def value_frequencies(df):
    return ranking.frequencies(ranking.values(df))


@over(java)
def frequency_ranking(df):
    return ranking.ranked(ranking.frequencies(ranking.values(df)))


@over(java)
def weighted_frequencies(df):
    return ranking.weighted(ranking.frequencies(ranking.values(df)))


@over(java)
def weighted_ranking(df):
    return (ranking.weighted(ranking.frequencies(ranking.values(df))).select("kind", "item", "weight")
            .orderBy(F.col("weight").desc(), "item", "kind").limit(TOP))


@over(texts)
def top_identifiers(df):
    freq = ranking.frequencies(ranking.values(df))
    return ranking.top(ranking.frequencies_of(freq, "identifiers"), TOP).select("item", "cnt")


@over(texts)
def missing_identifiers(df):
    freq = ranking.frequencies(ranking.values(df))
    return vocabulary.missing_identifiers(freq, vocabulary.base_vocabulary(df.sparkSession)).select("item", "cnt")


@over(texts)
def extended_vocabulary(df):
    return vocabulary.extended(vocabulary.base_vocabulary(df.sparkSession), ranking.frequencies(ranking.values(df)), EXTRA_IDS)


# --- Codec -----------------------------------------------------------------------------------------------------------
@over(texts)
def encode_files(df):
    return pipeline.encoded_files(df).select("file_id", "shard", "unicode")


@over(java)
def encode_java(df):
    return pipeline.encoded_files(df).select("file_id", "unicode")


@over(pages)
def encode_tokens(df):
    return tk.encoded_tokens(tk.pieces(df))


@over(java)
def encoded_lines(df):
    return tk.encoded_lines(df)


@over(java)
def token_ids(df):
    vocab = F.broadcast(vocabulary.base_vocabulary(df.sparkSession).select("token_id", "key"))     # 226 rows
    keyed = tk.tokens(df).withColumn("key", F.concat(F.lit("!LEX_"), "token_type"))
    return keyed.join(vocab, "key").select("file_id", "pos", "token_id")


@over(texts)
def identifier_ids(df):
    vocab = vocabulary.extended(vocabulary.base_vocabulary(df.sparkSession), ranking.frequencies(ranking.values(df)), EXTRA_IDS)
    return vocabulary.encode_identifiers(df, vocab).select("file_id", "pos", spaced(F.col("ids")).alias("ids"))


@over(texts)
def ids_to_characters(df):
    id_lines = tk.encoded_lines(df).withColumn("ids", cd.char_line_to_ids(F.col("unicode")))
    return id_lines.select("file_id", "line_no", cd.id_line_to_chars(F.col("ids")).alias("unicode"))


@over(texts)
def characters_to_ids(df):
    return tk.encoded_lines(df).select("file_id", "line_no", cd.char_line_to_ids(F.col("unicode")).alias("ids"))


@over(texts)
def alphabet_filter(df):
    mixed = pipeline.encoded_files(df).withColumn("unicode", F.concat("unicode", "path"))
    return filters.in_alphabet(mixed).select("file_id", "unicode")


@over(java)
def decode_characters(df):
    return pipeline.encoded_files(df).select("file_id", cd.decode(F.col("unicode")).alias("code"))


@over(texts)
def decode_ids(df):
    ids = pipeline.encoded_files(df).withColumn("ids", cd.char_line_to_ids(F.col("unicode")))
    return ids.select("file_id", cd.decode_id_text(F.col("ids")).alias("code"))


@over(texts)
def looked_up_ids(df):
    """Every second id is outside the vocabulary, so both outcomes of the lookup occur."""
    ids = pipeline.encoded_files(df).select(F.explode(cd.to_ids(F.col("unicode"))).alias("id"))
    counted = ids.select((F.col("id") * 2).cast("int").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
    return vocabulary.looked_up(counted, vocabulary.base_vocabulary(df.sparkSession)).select("token_id", "value", "n")


@over(texts)
def cut_at_line_end(df):
    return pipeline.encoded_files(df).select("file_id", cd.cut_at_line_end(F.col("unicode")).alias("unicode"))


# --- Byte pairs and examples -----------------------------------------------------------------------------------------
def _words(df: DataFrame) -> DataFrame:
    return bpe.words_of(pipeline.unicode_lines(pipeline.encoded_files(df)))


@over(texts)
def line_multiset(df):
    return bpe.word_counts(pipeline.unicode_lines(pipeline.encoded_files(df)))


@over(texts)
def pair_counts(df):
    return bpe.pair_counts(_words(df))


@over(texts)
def frequent_pairs(df):
    return bpe.frequent(bpe.pair_counts(_words(df)))


@over(texts)
def best_pairs(df):
    return bpe.best_pairs(bpe.pair_counts(_words(df)), TOP)


@with_model()
def train_merges(encoded, model):
    return model.merge_table(encoded.sparkSession).drop("token")


@with_model()
def encode_bpe(encoded, model):
    lines = pipeline.unicode_lines(encoded)
    ids = bpe.encode_ids(encoded.sparkSession, F.col("unicode"), model)
    return lines.select("file_id", "line_no", spaced(ids).alias("ids"))


@with_model()
def corpus_token_count(encoded, model):
    return bpe.token_totals(pipeline.unicode_lines(encoded), model)


@with_model()
def folder_token_count(encoded, model):
    return bpe.folder_totals(pipeline.unicode_lines(encoded), model)


@with_model()
def running_token_rate(encoded, model):
    return progress.running_rate(encoded, model, REPORT_EVERY)


@over(texts)
def baseline_token_count(df):
    return compare.baseline_totals(df, size=SWEEP[-1])


@with_model()
def vocabulary_sweep(encoded, model):
    return bpe.size_sweep(bpe.words_of(pipeline.unicode_lines(encoded)), model, SWEEP)


def _compared(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """``fn(series, baseline)``: the sweep, and a unigram tokenizer with as many pieces as the largest vocabulary."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        series = Tables(spark).replace("series", _QUERIES["vocabulary_sweep"](spark, folder))       # one row per size
        baseline = compare.baseline_totals(texts(spark, folder), size=SWEEP[-1])
        return fn(series, baseline.select(F.lit(SWEEP[-1]).alias("vocab_size"), "total_tokens"))
    return run


_QUERIES["baseline_improvement"] = _compared(compare.improvement)
_QUERIES["nearest_to_baseline"] = _compared(
    lambda series, baseline: compare.nearest(series.withColumn("ordinal", F.col("vocab_size")), baseline))


@with_model()
def training_examples(encoded, model):
    built = examples.build(encoded, model, MAX_LENGTH)
    return built.select("file_id", *(spaced(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")))


@with_model()
def truncation_report(encoded, model):
    return examples.truncation(encoded, model, MAX_LENGTH)


@over(texts)
def split_content_overlap(df):
    return sharding.shared_contents(df, TRAIN_RATIO)


@over(texts)
def sampled_training(df):
    """Learn on the sample of shards, apply to both sides of the split: lines and tokens of each."""
    spark = df.sparkSession
    encoded = Tables(spark).replace("encoded", pipeline.encoded_files(df), "shard")
    sample = pipeline.unicode_lines(sharding.sample_shards(encoded, SAMPLE_PERCENT))
    model = bpe.train(bpe.words_of(sample), len(bpe.SPECIAL_TOKENS) + cd.BASE_SIZE + SAMPLE_MERGES)
    sides = [("training", sharding.training_files), ("evaluation", sharding.evaluation_files)]
    counted = [bpe.token_totals(pipeline.unicode_lines(split(encoded, TRAIN_RATIO)), model).select(
        F.lit(side).alias("side"), "lines", "tokens") for side, split in sides]
    return counted[0].unionByName(counted[1])


# --- The learned vocabulary in readable form ---------------------------------------------------------------------------
def _id_map(spark: SparkSession) -> DataFrame:
    return vocabulary.base_vocabulary(spark).select(F.col("token_id").cast("string").alias("token_id"), F.col("value").alias("text"))


@with_model()
def readable_vocabulary(encoded, model):
    spark = encoded.sparkSession
    return vocabulary.readable_lines(model.vocabulary(spark), _id_map(spark))


@with_model()
def id_vocabulary(encoded, model):
    return vocabulary.id_lines(model.vocabulary(encoded.sparkSession))


@with_model()
def special_entries(encoded, model):
    return model.vocabulary(encoded.sparkSession).where(filters.is_special(F.col("token")))


@with_model()
def trainer_vocabulary(encoded, model):
    """The vocabulary put together from special tokens, letters and merges."""
    spark = encoded.sparkSession
    merged = model.merge_table(spark).select("rank", "token")
    return vocabulary.trainer_vocabulary(spark, list(bpe.SPECIAL_TOKENS), model.alphabet, merged)


# --- Written and read again ----------------------------------------------------------------------------------------------
def _written(df: DataFrame, write: Callable[[DataFrame, str], None]) -> str:
    path = Tables(df.sparkSession).folder("output")
    write(df, path)
    return path


@over(texts)
def written_shards(df):
    path = _written(df, lambda d, p: sinks.write_shards(d.drop("shard"), p, SHARD_ROWS))
    return df.sparkSession.read.parquet(path).select("file_id", "shard", F.md5("content").alias("content_md5"))


@over(texts)
def written_cleaned(df):
    path = _written(df, sinks.write_cleaned)
    return df.sparkSession.read.parquet(path).select("file_id", "shard", "size", F.md5("content").alias("content_md5"))


@over(java)
def written_values(df):
    path = _written(df, sinks.write_values)
    read = df.sparkSession.read.option("lineSep", "\n").text(path).where("value <> ''")
    return read.groupBy("kind", "value").agg(F.count("*").alias("n"))


@over(texts)
def written_encoded(df):
    path = _written(df, lambda d, p: sinks.write_encoded(pipeline.encoded_files(d), p))
    return df.sparkSession.read.parquet(path).select("shard", "file_path", F.md5("unicode").alias("unicode_md5"))


@over(texts)
def written_corpus(df):
    path = _written(df, sinks.write_corpus)
    return textfiles.read_lines(df.sparkSession, path).groupBy("line").agg(F.count("*").alias("n"))


@with_model()
def stored_model(encoded, model):
    """The model written as two tables and read again, as merges."""
    spark = encoded.sparkSession
    path = Tables(spark).folder("model")
    sinks.write_model(model, spark, path)
    again = bpe.BpeModel.from_tables(spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/merges"))
    return again.merge_table(spark).select("rank", "left_id", "right_id", "new_id")


def _archived(df: DataFrame, bytes_of: Callable[[], Column]) -> str:
    """Archives of the files in shards of ``SHARD_ROWS``, in a folder; ``bytes_of`` gives an entry's bytes."""
    folder = Tables(df.sparkSession).folder("archives")
    rows = sharding.assign_shards(df.drop("shard"), SHARD_ROWS).select("shard", "path", bytes_of().alias("data"))
    archives.write_archives(rows, folder)
    return folder


@over(texts)
def archived_files(df):
    """Written as archives and read entry by entry."""
    folder = _archived(df, lambda: F.encode("content", "UTF-8"))
    entries = archives.content_of(archives.read_archives(df.sparkSession, folder, ".java"))
    return entries.select("shard", "path", F.md5("content").alias("content_md5"))


@over(texts)
def unreadable_entries(df):
    """Every ninth file ends in a byte that is no UTF-8; the scan goes on and tells which."""
    planted = F.when(F.col("file_id") % 9 == 0, F.unhex(F.lit("ff"))).otherwise(F.unhex(F.lit("")))
    folder = _archived(df, lambda: F.concat(F.encode("content", "UTF-8"), planted))
    entries = archives.scan_archives(df.sparkSession, folder)
    return filters.unreadable(entries).unionByName(entries.where("error IS NOT NULL").drop("data")).select("shard", "path", "error")


@over(texts)
def archived_ids(df):
    """The ids of the files as 16-bit records in binary files, read and decoded."""
    encoded = sharding.assign_shards(pipeline.encoded_files(df).drop("shard"), SHARD_ROWS)
    joined = F.array_sort(F.collect_list(F.struct("file_id", "unicode")))                # at most SHARD_ROWS files
    shards = encoded.groupBy("shard").agg(F.array_join(F.transform(joined, lambda x: x["unicode"]), "").alias("unicode"))
    folder = Tables(df.sparkSession).folder("ids")
    archives.write_files(shards.select(F.concat("shard", F.lit(".bin")).alias("name"), cd.ids_to_shorts(cd.to_ids(F.col("unicode"))).alias("data")), folder)
    read = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return read.select(F.regexp_extract("path", r"([^/]+)\.bin\z", 1).alias("shard"), cd.shorts_to_id_text(F.col("content")).alias("id_text"))


@over(texts)
def text_files(df):
    """One file for each text in a folder per shard, read as whole files."""
    folder = Tables(df.sparkSession).folder("files")
    name = F.concat(F.lit("processed_"), F.coalesce("shard", F.lit("none")), F.lit("/"), F.col("file_id").cast("string"), F.lit(".txt"))
    archives.write_files(df.select(name.alias("name"), F.encode("content", "UTF-8").alias("data")), folder)
    read = textfiles.read_files(df.sparkSession, folder, "processed_*")
    return read.select("shard", "path", F.md5("content").alias("content_md5"))


@over(texts)
def id_map_file(df):
    """The extended vocabulary as lines of a file, read as a map."""
    extended = vocabulary.extended(vocabulary.base_vocabulary(df.sparkSession), ranking.frequencies(ranking.values(df)), EXTRA_IDS)
    path = _written(extended, lambda d, p: sinks.write_ordered_lines(vocabulary.vocabulary_lines(d), p))
    return textfiles.read_id_map(df.sparkSession, path)


@over(texts)
def frequency_file(df):
    """Frequencies of identifiers as lines of a file, read and weighted."""
    freq = ranking.frequencies_of(ranking.frequencies(ranking.values(df)), "identifiers")
    path = _written(freq, sinks.write_frequencies)
    return ranking.weighted(textfiles.read_frequencies(df.sparkSession, path))


# --- Streams: the table arrives as a stream, the totals it ends with are returned --------------------------------------
def _streamed(make: Callable[[DataFrame], DataFrame], source: Callable[[DataFrame], DataFrame], keys: list[str], value: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        totals = make(source(ingest.table_stream(spark, f"{folder}/documents.parquet")))
        kept = Tables(spark)
        ingest.start_totals(totals, kept.folder("progress"), ingest.changes_to(kept.folder("changes"))).awaitTermination()
        return ingest.latest(spark, kept.folder("changes"), totals, keys, value)

    return run


_QUERIES["streamed_category_counts"] = _streamed(ingest.running_categories, tb.java_files, ["category"], "n")
_QUERIES["streamed_frequencies"] = _streamed(ingest.running_frequencies, tb.from_documents, ["kind", "item"], "cnt")


@over(java)
def restarted_ingest(df):
    """The files arrive in parts; the stream stops after its first batch and goes on from its checkpoint."""
    spark, kept = df.sparkSession, Tables(df.sparkSession)
    source, out, progress = (kept.folder(n) for n in ("arrived", "ingested", "progress"))
    df.repartition(STREAM_FILES, "file_id").write.parquet(source)
    ingest.ingest(spark, source, out, progress, files_per_trigger=1, batches=1).awaitTermination()
    ingest.ingest(spark, source, out, progress, files_per_trigger=STREAM_FILES // 2).awaitTermination()
    return spark.read.parquet(out).select("file_id", "shard", F.md5("unicode").alias("unicode_md5"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
