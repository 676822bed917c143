"""The queries of this package, each over its whole table, and their SQL where DuckDB can express it.

Without SQL are the operators whose results rest on learned models (2, 7) or on eigenvectors (13), on set similarity over
all documents (4), on templates (1), and on a tokenizer's merges (11); their tests compare them with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import bytebpe, chat, decontaminate, digests, html, jaccard, language, manifest, mixing, sharding, statements, templates, warc, whitening

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.without_recurring(spark, table(spark, folder, "documents")).withColumnRenamed("_id", "doc_id")


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(spark, table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return digests.mark_copies(spark, table(spark, folder, "documents")).withColumnRenamed("_id", "doc_id")


def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.shingle_components(spark, table(spark, folder, "documents")).withColumnRenamed("_id", "doc_id")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, folder, "pages"))


def op6_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chat.report(chat.probe(table(spark, folder, "conversations")))


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extracted(spark, table(spark, folder, "pages")).withColumnRenamed("_id", "page_id")


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_rows(spark, table(spark, folder, "documents")).drop("copies").withColumnRenamed("_id", "doc_id")


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.placed(spark, table(spark, folder, "documents"), SHARDS).select("doc_id", "slot", "shard")


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = bytebpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = bytebpe.encoded(spark, table(spark, folder, "documents"), vocabulary)
    return bytebpe.report(bytebpe.decoded(spark, ids, vocabulary))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    leaves = manifest.tampered_leaves(table(spark, folder, "documents"))
    return manifest.verified(manifest.manifest(spark, leaves))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.report(spark, table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_templates, op2_language_id, op3_exact_dedup, op4_ngram_jaccard, op5_warc, op6_chat_windows,
                            op7_main_text, op8_source_mix, op9_decontaminate, op10_sharding,
                            op11_byte_bpe, op12_merkle_manifest, op13_embedding_whitening)}

_OWNERS = sharding.lookup_table(SHARDS)

SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH hashed AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), '{digests.UPPER}', '{digests.LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM hashed WINDOW same AS (PARTITION BY text_sha256)""",
    "op8_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)
                       / CAST(4503599627370496 AS DOUBLE) AS u
            FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
                   (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
            FROM sized GROUP BY source),
        levels AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))::DOUBLE
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS level, cap / weight AS full_at
            FROM sources
            WINDOW earlier AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        targets AS (
            SELECT source, source_size, least(cap::DOUBLE, weight * (
                SELECT level FROM levels WHERE full_at >= level ORDER BY full_at, source NULLS LAST LIMIT 1)) AS target
            FROM levels),
        copies AS (
            SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::INT AS whole FROM targets),
        rests AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM copies),
        -- Classes of one weight, heaviest first: certain as long as the chance of the next one would reach 1.
        classes AS (
            SELECT source, rest, length(bin(size)) AS w, sum(size)::DOUBLE AS words, sum(length(bin(size)) * size)::DOUBLE AS mass
            FROM sized JOIN rests USING (source) WHERE size > 0 AND rest > 0 GROUP BY ALL
            UNION ALL
            SELECT NULL, rest, length(bin(size)), sum(size)::DOUBLE, sum(length(bin(size)) * size)::DOUBLE
            FROM sized JOIN rests ON sized.source IS NULL AND rests.source IS NULL WHERE size > 0 AND rest > 0 GROUP BY ALL),
        tried AS (
            SELECT *, w * (rest - coalesce(sum(words) OVER above, 0)) >= sum(mass) OVER (PARTITION BY source) - coalesce(sum(mass) OVER above, 0) AS over
            FROM classes WINDOW above AS (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        judged AS (SELECT *, bool_and(over) OVER (PARTITION BY source ORDER BY w DESC) AS certain FROM tried),
        shared AS (
            SELECT source, min(w) FILTER (certain) AS certain_from, max(rest) - coalesce(sum(words) FILTER (certain), 0) AS left_over,
                   coalesce(sum(mass) FILTER (NOT certain), 0) AS left_mass
            FROM judged GROUP BY source),
        chances AS (
            SELECT doc_id, size, u, sized.source, source_size, target, whole, left_over,
                   coalesce(size > 0 AND length(bin(size)) >= certain_from, FALSE) AS certain,
                   least(left_over * length(bin(size)) / nullif(left_mass, 0), 1 - 1 / 1099511627776.0::DOUBLE) AS p
            FROM sized JOIN rests ON sized.source IS NOT DISTINCT FROM rests.source
            LEFT JOIN shared ON sized.source IS NOT DISTINCT FROM shared.source),
        ordered AS (
            SELECT *, sum(CASE WHEN certain THEN 0 ELSE size END) OVER (
                       PARTITION BY source, certain ORDER BY (u / (1 - u)) / nullif(p / (1 - p), 0), CAST(doc_id AS BIGINT)) AS until
            FROM chances)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               (size * (whole + (certain OR coalesce(left_over > 0 AND size > 0 AND until - size / 2 <= left_over, FALSE))::INT))::BIGINT AS taken
        FROM ordered""",
    "op10_sharding": f"""
        WITH hashed AS (
            SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) % {len(_OWNERS)} AS slot
            FROM documents)
        SELECT doc_id, slot::INT AS slot, ({_OWNERS})[slot + 1]::INT AS shard FROM hashed""",
    "op5_warc": statements.WARC,
    "op6_chat_windows": statements.chat_windows(),
    "op9_decontaminate": statements.decontamination(),
    "op12_merkle_manifest": statements.MERKLE_MANIFEST,
}
