"""Vocabulary tables: the model vocabulary, its extension by frequent identifiers, readable forms of learned tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import codec as cd
from tokenloom.functions import lexing as lx
from tokenloom.operators import filters, ranking
from tokenloom.operators import tokens as tk


def base_vocabulary(spark: SparkSession) -> DataFrame:
    """(token_id, key, value): the 226 entries."""
    return spark.createDataFrame(cd.BASE_VOCABULARY, "token_id smallint, key string, value string")


def bounded(vocabulary: DataFrame) -> DataFrame:
    """To be broadcast if it has no more rows than ids fit one character; a longer table of the caller is shuffled."""
    fits = vocabulary.limit(cd.MAX_VOCABULARY + 1).count() <= cd.MAX_VOCABULARY
    return F.broadcast(vocabulary) if fits else vocabulary


def missing_identifiers(freq: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Identifier frequencies whose text is no key of the vocabulary."""
    keys = bounded(vocabulary.select(F.col("key").alias("item")))
    return freq.where(F.col("kind") == "identifiers").join(keys, "item", "left_anti")


def extended(vocabulary: DataFrame, freq: DataFrame, how_many: int) -> DataFrame:
    """Append the most frequent identifiers that are not keys yet, with the next free ids."""
    if vocabulary.limit(cd.MAX_VOCABULARY + 1).count() + how_many > cd.MAX_VOCABULARY:
        raise ValueError(f"at most {cd.MAX_VOCABULARY} ids fit one character each")
    new = ranking.top(missing_identifiers(freq, vocabulary), how_many)
    # At most how_many rows reach this window and this maximum.
    rank = F.row_number().over(Window.orderBy(*ranking.by_count()))
    last = vocabulary.agg(F.max("token_id")).scalar()
    added = new.select((last + rank).cast("smallint").alias("token_id"), F.col("item").alias("key"), F.col("item").alias("value"))
    return vocabulary.unionByName(added)


def encode_identifiers(files: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(file_id, pos, text, ids): each identifier as its own id if it has one, else marker and spelling."""
    identifiers = tk.pieces(files).where(lx.is_identifier(F.col("text")))
    known = bounded(vocabulary.where(~F.col("key").startswith("!LEX_")).select(F.col("key").alias("text"), "token_id"))
    spelled = cd.to_ids(cd.encode_identifier(F.col("text"), mark_single_char=True))
    ids = F.when(F.col("token_id").isNotNull(), F.array(F.col("token_id"))).otherwise(spelled)
    return identifiers.join(known, "text", "left").select("file_id", "pos", "text", ids.alias("ids"))


def encode_with(files: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(file_id, ids): files encoded with an extended vocabulary, stripped non-empty lines first."""
    from tokenloom.functions.text import compact_text
    compact = files.withColumn("content", compact_text(F.col("content"))).where(F.col("content") != "")
    known = bounded(vocabulary.where((F.col("token_id") >= cd.BASE_SIZE)).select(F.col("key").alias("text"), "token_id"))
    found = tk.pieces(compact, ordered=True).join(known, "text", "left")
    plain = cd.to_ids(cd.encode_token(F.col("text")))
    ids = F.when(F.col("token_id").isNotNull() & lx.is_identifier(F.col("text")),
                 F.array(F.col("token_id"))).otherwise(plain)
    rows = found.select("file_id", "pos", ids.alias("ids")).where(F.size("ids") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "ids")))
    return rows.groupBy("file_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def looked_up(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add key and value to (token_id); an unknown id has the value ``<?>``."""
    joined = ids.join(bounded(vocabulary), "token_id", "left")
    return joined.withColumn("value", F.coalesce("value", F.lit("<?>")))


def vocabulary_lines(vocabulary: DataFrame) -> DataFrame:
    """(token_id, value): the lines ``id key value`` with line ends escaped, in id order."""
    escaped = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit("\\n"))
    line = F.concat_ws(" ", F.col("token_id").cast("string"), escaped("key"), escaped("value"))
    return vocabulary.select("token_id", line.alias("line")).orderBy("token_id")


# --- Learned tokens in readable form ------------------------------------------------------------------------------
def _readable_parts(token: Column, id_map: dict[str, str]) -> Column:
    """Texts of a token's ids; the identifier marker is left out, an id without text is ``UNK_ID_<id>``."""
    table = F.create_map(*(F.lit(x) for kv in id_map.items() for x in kv))

    def one(i: Column) -> Column:
        name = i.cast("string")
        return F.coalesce(F.try_element_at(table, name), F.concat(F.lit("UNK_ID_"), name))

    return F.filter(F.transform(cd.to_ids(token), one), lambda t: ~F.contains(t, F.lit("IDENTIFIER")))


def id_lines(bpe_vocabulary: DataFrame) -> DataFrame:
    """(bpe_id, line): ``ids<TAB>bpe_id`` in id order; special tokens as they are."""
    token = F.col("token")
    shown = F.when(filters.is_special(token), token).otherwise(cd.char_line_to_ids(token))
    return bpe_vocabulary.select("bpe_id", F.concat_ws("\t", shown, F.col("bpe_id").cast("string")).alias("line")).orderBy("bpe_id")


def readable_lines(bpe_vocabulary: DataFrame, id_map: DataFrame) -> DataFrame:
    """(bpe_id, line): ``a + b -> "ab"<TAB>bpe_id``; one part is shown plainly, special tokens as they are.

    ``id_map`` is (token_id STRING, text): at most cd.MAX_VOCABULARY rows, read into a constant.
    """
    rows = id_map.limit(cd.MAX_VOCABULARY + 1).collect()
    if len(rows) > cd.MAX_VOCABULARY:
        raise ValueError(f"an id map has at most {cd.MAX_VOCABULARY} rows")
    table = {r.token_id: r.text for r in rows}
    token, parts = F.col("token"), F.col("parts")
    merged = F.concat(F.array_join(parts, " + "), F.lit(' -> "'), F.array_join(parts, ""), F.lit('"'))
    shown = (F.when(filters.is_special(token), token).when(F.size(parts) == 1, F.element_at(parts, 1)).otherwise(merged))
    return (bpe_vocabulary.withColumn("parts", _readable_parts(token, table))
            .select("bpe_id", F.concat_ws("\t", shown, F.col("bpe_id").cast("string")).alias("line")).orderBy("bpe_id"))


def readable_text(ids: Column, id_map: dict[str, str]) -> Column:
    """array<string>: texts of an id array under the same rules."""
    return _readable_parts(cd.from_ids(ids), id_map)


def trainer_vocabulary(spark: SparkSession, special: list[str], letters: list[str], merged: DataFrame) -> DataFrame:
    """(bpe_id, token): special tokens, then letters in code point order, then merged strings not present yet.

    ``merged`` is (rank, token).
    """
    fixed = list(enumerate([*special, *sorted(letters)]))
    start = spark.createDataFrame(fixed, "bpe_id int, token string")
    new = merged.join(F.broadcast(start), "token", "left_anti").groupBy("token").agg(F.min("rank").alias("rank"))
    numbered = new.select((F.row_number().over(Window.orderBy("rank")) + (len(fixed) - 1)).alias("bpe_id"), "token")
    return start.unionByName(numbered)
