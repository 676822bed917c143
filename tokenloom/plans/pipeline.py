"""The whole preparation as composed transforms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import codec as cd
from tokenloom.operators import bpe, cleaning, examples, filters, sharding
from tokenloom.session import Tables


def cleaned_files(files: DataFrame) -> DataFrame:
    """(file_id, shard, path, content): garbage and unbalanced files dropped, the rest cleaned and laid out, row by row."""
    return files.transform(filters.keep_usable, tokens=True).transform(cleaning.clean).select("file_id", "shard", "path", "content")


def encoded_files(files: DataFrame) -> DataFrame:
    """(file_id, shard, path, unicode): files with at least one model token."""
    encoded = files.select("file_id", "shard", "path", cd.encode_file(F.col("content")).alias("unicode"))
    return filters.where_once(encoded, F.col("unicode") != "")


def unicode_lines(encoded: DataFrame) -> DataFrame:
    """(file_id, shard, line_no, unicode): the lines of encoded files."""
    return (encoded.select("file_id", "shard", F.posexplode(F.split("unicode", "\n")).alias("line_no", "unicode"))
            .where(F.col("unicode") != ""))


@dataclass
class Prepared:
    model: bpe.BpeModel
    training: DataFrame
    evaluation: DataFrame


def prepare(files: DataFrame, vocab_size: int = bpe.TARGET_SIZE, sample_percent: int = 5, ratio: float = 0.999,
            max_length: int = examples.MAX_LENGTH) -> Prepared:
    """Source files to examples: encode, learn the vocabulary on a shard sample, split by shard, build examples.

    Texts are encoded once, into a table with a folder per shard: names, sample and splits then prune folders."""
    tables = Tables(files.sparkSession)
    encoded = tables.replace("encoded", encoded_files(files).hint("rebalance", "shard"), "shard")
    sample = unicode_lines(sharding.sample_shards(encoded, sample_percent))
    model = bpe.train(bpe.words_of(sample), vocab_size)
    build = lambda part: examples.build(part, model, max_length)
    return Prepared(model, build(sharding.training_files(encoded, ratio)), build(sharding.evaluation_files(encoded, ratio)))
