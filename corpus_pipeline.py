"""The documents of a training corpus, from raw rows to shards; each stage is written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import decontaminate, jaccard, language, mixing, sharding
from tokenloom.llm.queries import SHARDS
from tokenloom.session import shared_folder


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, mostly in letters that no labelled text has, or whose parse in the language
    that wins takes more bits than its labelled text lets expect, go."""
    return language.in_known_languages(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the smallest id stays."""
    return jaccard.one_of_each_group(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a test item go."""
    return decontaminate.decontaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as the mix takes it."""
    return mixing.mixture(spark, docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: the columns of documents, ``slot`` and ``shard``."""
    return sharding.placed(spark, docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_languages), ("ngram_jaccard_join", near_copies), ("decontamination", without_benchmark),
    ("source_mix", mixed), ("sharding", sharded),
]

#: Language identification rests on learned automata, which SQL cannot express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
