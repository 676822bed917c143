"""Mixing sources to target weights (8): whole copies, then Pareto order sampling of the rest.

Each source gets its share of all words by weight, but at most ``most`` times its own; the excess goes to the others by
weight until none is above.  With target / size = whole + rest, every document is taken ``whole`` times, and the rest is
a sample in which documents have unequal chances p, in proportion to their weight: the weight column, or by default the
number of bits of the word count, so longer documents come in sooner.  Documents whose p would reach 1 are certain: they get
the copy, are taken out, and p is shared anew among the others until none reaches 1.  The others are ranked by their
random odds u/(1-u) divided by their inclusion odds p/(1-p), and taken in this order until the words of the rest are
reached, to within half a document.

No text is shuffled and no source is sorted as a whole.  The ranks are cut into buckets; bucket totals say in which
bucket a source's sample ends, and only that bucket's rows are put in order.  What the rows need then is one row per
source: the least weight that is certain, and the last document taken.  Each round that looks for certain documents is a sum
per source; a round lowers the least certain weight, so there are few.

Defined cases: null text has no words; a null source is a source, ordered last; documents without words get the whole
copies but are never sampled; weights are read to six decimals, at most 10^9, null as 1, NaN and negative ones as 0; a document
of weight 0 gets no sampled copy, so a source may then miss its target; rows that repeat an id in a source are taken
together if they also agree in weight; a null id is drawn as the string ``null``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.session import Tables

WORDS = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024              # of ranks, for each source
FEW_SOURCES = 100_000       # one row each; more are joined by a shuffle


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("bigint")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key alone, so reruns and lost tasks agree."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def length_weight(size: Column) -> Column:
    """The number of bits of a word count."""
    return F.length(F.bin(size)).cast("decimal(16,6)")


def _weight(column: str | None, size: Column) -> Column:
    """A decimal, whose sums don't depend on the order of rows."""
    if column is None:
        return length_weight(size)
    given = F.nanvl(F.coalesce(F.col(column).cast("double"), F.lit(1.0)), F.lit(0.0))      # NaN is above all numbers in Spark
    return F.least(F.greatest(given, F.lit(0.0)), F.lit(1e9)).cast("decimal(16,6)")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, and its whole copies and rest.  Windows here run
    over the sources, not over documents."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"),
                                           F.sum(F.col("mass_weight") * F.col("size")).cast("double").alias("mass"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # The level at which the water stands once all sources before this one are full; the first that isn't full decides.
    levels = sources.withColumn("level", left / share)
    level = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_rows)
    filled = levels.withColumn("target", F.least(F.col("cap").cast("double"), level["level"] * F.col("weight")))
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    return filled.withColumn("whole", F.floor(rate).cast("int")).withColumn(
        "rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))).select(
        "source", "source_size", "mass", "target", "whole", "rest")


def _is_certain() -> Column:
    return F.coalesce(F.col("mass_weight") >= F.col("certain_from"), F.lit(False))


def with_certain_copies(tables: Tables, sizes: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Add ``certain_from``, the least weight whose documents surely get a copy of the rest (null: none), and take their words
    and mass out of ``rest`` and ``mass``."""
    sources = tables.replace("sources", sources.withColumn("certain_from", F.lit(None).cast("decimal(16,6)")).withColumns(
        {"all_rest": F.col("rest"), "all_mass": F.col("mass")}))
    while True:
        surely = (F.col("mass_weight") > 0) & (F.col("mass_weight").cast("double") * F.col("rest") >= F.col("mass"))
        certain = _with_targets(sizes.where("size > 0"), sources, few).where((F.col("all_rest") > 0) & (_is_certain() | surely))
        sums = certain.groupBy(F.col("source").alias("_s")).agg(
            F.min("mass_weight").alias("_from"), F.sum("size").alias("_size"),
            F.sum(F.col("mass_weight") * F.col("size")).cast("double").alias("_mass"))
        found = sources.join(sums, sources["source"].eqNullSafe(sums["_s"]), "left").drop("_s")
        moved = ~F.col("_from").eqNullSafe(F.col("certain_from"))
        found = tables.replace("sources", found.select(
            *(c for c in sources.columns if c not in ("rest", "mass", "certain_from")), moved.alias("moved"),
            F.col("_from").alias("certain_from"),
            F.greatest(F.col("all_rest") - F.coalesce(F.col("_size"), F.lit(0)), F.lit(0.0)).alias("rest"),
            F.greatest(F.col("all_mass") - F.coalesce(F.col("_mass"), F.lit(0.0)), F.lit(0.0)).alias("mass")))
        sources = found.drop("moved")
        if found.where("moved").isEmpty():
            return sources.drop("all_rest", "all_mass")


def _ranked(rows: DataFrame, seed: str) -> DataFrame:
    """Add ``q``, the random odds over the inclusion odds, and ``bucket``, which grows with it; neither for certain documents."""
    below_one = F.lit(1 - 2.0 ** -40)
    chance = F.least(F.col("rest") * F.col("mass_weight").cast("double") / F.when(F.col("mass") > 0, F.col("mass")), below_one)
    middle = F.least(F.col("rest") / F.when(F.col("source_size") > 0, F.col("source_size")), below_one)
    u = draw(F.col("_id"), seed)
    ranked = rows.withColumn("q", F.when(~_is_certain(), F.try_divide(u / (1 - u), chance / (1 - chance))))
    even = F.col("q") * (middle / (1 - middle))
    return ranked.withColumn("bucket", F.floor(BUCKETS * even / (1 + even)).cast("int"))


def _with_targets(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    own = sources.withColumnRenamed("source", "_source")
    own = F.broadcast(own) if few else own
    return rows.join(own, rows["source"].eqNullSafe(own["_source"])).drop("_source")


def _measured(docs: DataFrame, id_column: str, text_column: str, source_column: str, weight_column: str | None) -> DataFrame:
    size = word_count(F.col(text_column))
    return docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_column).alias("_id"),
                       F.col(source_column).cast("string").alias("source"), size.alias("size"),
                       _weight(weight_column, size).alias("mass_weight"))


def plan(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> tuple[DataFrame, bool]:
    """For each source its target, whole copies, the least certain weight and the last sampled document (``last``: q and id);
    and whether the sources are few enough to broadcast."""
    tables = Tables(spark)
    sizes = tables.replace("sizes", sizes)
    sources = tables.replace("targets", targets(sizes, weights, most))
    few = sources.count() <= FEW_SOURCES
    sources = with_certain_copies(tables, sizes, sources, few)
    ranked = _ranked(_with_targets(sizes.where("size > 0"), sources, few).where("rest > 0"), seed)
    ranked = ranked.where("bucket is not null").drop("source_size", "mass", "target", "whole")
    totals = ranked.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # The sample ends in the last bucket that begins before the rest is reached.
    ends = totals.where("before < rest").groupBy("source").agg(F.max(F.struct("bucket", "before")).alias("_e")).select(
        F.col("source").alias("_source"), F.col("_e.bucket").alias("_bucket"), F.col("_e.before").alias("before"))
    ends = F.broadcast(ends) if few else ends
    inside = ranked.join(ends, ranked["source"].eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    running = Window.partitionBy("source").orderBy("q", "_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_until", F.col("before") + F.sum("size").over(running))
    own = F.sum("size").over(Window.partitionBy("source", "q", "_id"))
    inside = inside.withColumn("_take", F.col("_until") - own / 2 <= F.col("rest"))
    lasts = inside.groupBy("source").agg(
        F.max(F.when(F.col("_take"), F.struct("q", "_id"))).alias("last"), F.first("bucket").alias("last_bucket"))
    lasts = lasts.select(F.col("source").alias("_s"), "last", "last_bucket")
    planned = sources.join(lasts, sources["source"].eqNullSafe(lasts["_s"]), "left").drop("_s")
    return tables.replace("plan", planned), few


def _copies(ranked: DataFrame) -> DataFrame:
    """Whole copies, and one more for certain documents and up to the last sampled one; the last bucket may hold none of them."""
    sampled = (F.col("size") > 0) & (_is_certain() | (F.col("rest") > 0) & (
        (F.col("bucket") < F.col("last_bucket")) | ((F.col("bucket") == F.col("last_bucket")) & (F.struct("q", "_id") <= F.col("last")))))
    return ranked.withColumn("copies", F.col("whole") + F.coalesce(sampled, F.lit(False)).cast("int"))


def mixed_rows(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix",
               id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
               weight_column: str | None = None) -> DataFrame:
    """One row per document: ``_id``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies``."""
    sizes = Tables(spark).replace("measured", _measured(docs, id_column, text_column, source_column, weight_column).drop("_row"))
    planned, few = plan(spark, sizes, weights, most, seed)
    rows = _copies(_ranked(_with_targets(sizes, planned, few), seed))
    return rows.select("_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixture(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix",
            id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
            weight_column: str | None = None) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns of ``docs``."""
    packed = _measured(docs, id_column, text_column, source_column, weight_column)
    planned, few = plan(spark, packed.drop("_row"), weights, most, seed)
    rows = _copies(_ranked(_with_targets(packed, planned, few), seed)).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
