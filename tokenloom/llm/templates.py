"""Line dedup (1) by a tree of log templates.

A line's tokens (runs of non-space characters) that hold a digit are fields from the start, ``<*>``.  The tree has fixed
depth: the first level is the number of tokens, the next ones the ``DEPTH`` leading tokens.  In a leaf the line that occurs
most becomes a template, and lines that agree with it in at least ``AGREE`` of their places, one of them after the leading
ones, and have a constant in common with it, join it; where they differ the template has a field too.  A line of fields alone
(numbers, ids, links) says nothing about its form: it is a leaf of its own, unmasked, and recurs only as the same line.
This repeats on the lines that are left until fewer than ``documents`` of them could meet, which cannot recur; each of these
is a template of its own, without further fields.  Lines whose template occurs in at least ``documents`` documents are
dropped, all others stay.

A leaf is never gathered: the first ``LEADERS`` of its distinct lines, which tasks cut to so many each, give several
templates at a time, in the same order as one by one, and the others are joined to them; a round's lines are written.
Where a leaf has more distinct lines than that left after the first round, which takes in the lines of its most
frequent templates, it is cut into parts that have nothing to do with each other, so unlike lines take no rounds and
unlike templates share them: of two lines that agree in enough places, the rarest places of each (all but as many as
must agree, plus two) have two (place, token) in common, and the parts are the components of lines with a pair in
common.  Rounds grow with the templates of the largest part.  Leaves and parts with fewer lines than ``documents``
cannot hold a recurring template, so their lines go no further.  Texts move once, when the lines to drop meet their
document.

Defined cases: null text stays null and has no lines; blank lines stay; a line that repeats within a document counts
once; repeated rows are one document, and each is returned; the dropped lines' line ends go with them; null ids are told
apart by their text; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.graph import components
from tokenloom.llm.skew import join_groups
from tokenloom.session import Tables

DEPTH, AGREE = 3, 0.6
LEADERS = 64                  # most templates of a part that are found in one round
PAIRED = 24                   # lines of up to so many tokens are told apart by pairs of places, longer ones by single places
FIELD = "<*>"
FEW_LEAVES = 1_000_000        # leaf keys of 8 bytes that are broadcast; more are joined by a shuffle


def masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.when(x.rlike("[0-9]"), F.lit(FIELD)).otherwise(x))


def _form(tokens: Column) -> Column:
    """The masked tokens; of a line without a constant the tokens as they are."""
    return F.when(F.exists(tokens, _constant), masked(tokens)).otherwise(tokens)


def _constant(token: Column) -> Column:
    return ~token.rlike("[0-9]") & (token != FIELD)


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line that isn't blank: ``key``, ``line`` (its number), ``tokens`` and ``leaf``."""
    each = rows.select("key", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    each = each.select("key", "line", F.filter(F.split("content", r"\s+"), lambda x: x != "").alias("tokens")).where("size(tokens) > 0")
    leaf = F.when(F.exists("tokens", _constant), F.xxhash64(F.size("tokens"), masked(F.slice("tokens", 1, DEPTH))))
    return each.withColumn("leaf", F.coalesce(leaf, F.xxhash64(F.lit(0), "tokens")))


def _joins(body: Column, tokens: Column, leader: Column) -> Column:
    """Enough places agree, of those after the leading ones at least one, and some place holds the same constant."""
    same = F.zip_with(tokens, leader["tokens"], lambda x, y: x == y)
    further = F.slice(same, DEPTH + 1, F.greatest(F.size(same) - DEPTH, F.lit(0)))
    common = F.exists(F.zip_with(tokens, leader["tokens"], lambda x, y: (x == y) & (x != FIELD)), lambda x: x)
    return (body == leader["body"]) | ((F.size(F.filter(same, lambda x: x)) >= AGREE * F.size(same)) & common & (
        (F.size(further) == 0) | F.exists(further, lambda x: x)))


def _leaders(bodies: DataFrame) -> DataFrame:
    """The next templates of each part: of its ``LEADERS`` most frequent bodies those that join none before them, in order.
    These bodies come before all others, so the others change nothing about which of them lead."""
    order = Window.partitionBy("part").orderBy(F.desc("n"), F.desc("body"))
    top = bodies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS)
    top = top.groupBy("part").agg(F.first("_n").alias("_n"), F.array_sort(F.collect_list(
        F.struct("rank", "body", F.split("content", " ").alias("tokens")))).alias("top"))
    return top.select("part", "_n", F.aggregate("top", F.slice("top", 1, 0), lambda held, x: F.when(
        F.exists(held, lambda y: _joins(x["body"], x["tokens"], y)), held).otherwise(F.concat(held, F.array(x)))).alias("leaders"))


def _common_keys(inside: DataFrame) -> DataFrame:
    """``body``, ``key``: bodies of a leaf that join each other have a key in common.  ``inside`` has ``leaf``, ``_n`` (its
    bodies), ``body`` and ``tokens``.  Any order of (place, token) would do; here the tokens that one in ``LEADERS`` bodies of
    the leaf has in a place come last, by frequency.  Rows meet one row per leaf."""
    own = F.slice("tokens", DEPTH + 1, F.greatest(F.size("tokens") - DEPTH, F.lit(0)))
    counts = inside.select("leaf", "_n", F.posexplode(own).alias("place", "token")).groupBy("leaf", "place", "token").agg(
        F.count("*").alias("n"), F.first("_n").alias("_n"))
    often = counts.groupBy("leaf", "place").agg(F.first("_n").alias("_n"), F.collect_list(
        F.when(F.col("n") * LEADERS >= F.col("_n"), F.struct("token", "n"))).alias("often"))         # at most LEADERS
    often = often.groupBy("leaf").agg(F.first("_n").alias("_m"), F.array_sort(F.collect_list(F.struct("place", "often"))).alias("often"))
    items = join_groups(inside.drop("_n"), often, "leaf", "_m").select("body", F.size("tokens").alias("size"), F.array_sort(F.transform(
        own, lambda x, i: F.struct(F.coalesce(F.get(F.filter(F.get("often", i)["often"], lambda y: y["token"] == x), F.lit(0))["n"], F.lit(0)).alias("n"),
                                   F.xxhash64("leaf", i, x).alias("item")))).alias("items"))
    # Of the places after the leading ones so many agree, at least one.
    least = F.greatest(F.ceil(AGREE * F.col("size")).cast("int") - DEPTH, F.lit(1))
    paired = (least > 1) & (F.col("size") <= PAIRED)
    rarest = F.slice(F.col("items.item"), 1, F.size("items") - least + F.when(paired, 2).otherwise(1))
    items = items.select("body", paired.alias("paired"), rarest.alias("rarest"))
    pairs = F.flatten(F.transform("rarest", lambda x, i: F.transform(
        F.slice("rarest", i + 2, F.size("rarest")), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))
    return items.select("body", F.explode(F.when(F.col("paired"), pairs).otherwise(F.col("rarest"))).alias("key"))


def _parts(tables: Tables, bodies: DataFrame) -> DataFrame:
    """Add ``part``: bodies that could join each other are in one part.  Of leaves with few bodies it is the leaf."""
    leaves = bodies.groupBy("leaf").agg(F.count("*").alias("_n"))
    large = tables.replace("large", leaves.where(F.col("_n") > LEADERS))
    if large.isEmpty():
        return bodies.withColumn("part", F.col("leaf"))
    inside = tables.replace("inside", join_groups(bodies, large, "leaf", "_n").select(
        "leaf", "_n", "body", F.split("content", " ").alias("tokens")))
    keys = tables.replace("keys", _common_keys(inside))
    first = keys.groupBy("key").agg(F.min("body").alias("b"), F.count("*").alias("_n")).where("_n > 1")
    links = join_groups(keys, first, "key", "_n").select(F.col("body").alias("a"), "b")
    # A body that is the smallest of its component or has no links is a part by itself until others join it.
    found = components(tables, links, "parts").select(F.col("a").alias("body"), F.col("b").alias("_b"))
    # Lines without places after the leading ones are equal in all places of their leaf, or in none of them.
    of_large = inside.where(F.size("tokens") > DEPTH).select("body").join(found, "body", "left")
    of_large = of_large.select("body", F.xxhash64(F.lit("part"), F.coalesce("_b", "body")).alias("_part"))
    return bodies.join(of_large, "body", "left").withColumn("part", F.coalesce("_part", "leaf")).drop("_part")


def recurring_lines(spark: SparkSession, rows: DataFrame, documents: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` has ``key`` and ``text``.  The lines to drop (``key``, ``line``), and the recurring templates (``leaf``,
    ``template``, ``documents``, ``text``)."""
    tables = Tables(spark)
    leaves = _lines(rows).groupBy("leaf").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
    leaves = tables.replace("leaves", leaves.where((F.col("n") >= documents) & (F.col("a") != F.col("b"))).select("leaf"))
    own = F.broadcast(leaves) if leaves.count() <= FEW_LEAVES else leaves
    lines = _lines(rows).join(own, "leaf", "left_semi").withColumn("tokens", _form(F.col("tokens")))
    lines = lines.withColumn("body", F.xxhash64("tokens"))
    lines = tables.replace("lines", lines.select("leaf", "body", "key", "line", F.array_join("tokens", " ").alias("content")))
    bodies = tables.replace("bodies", lines.groupBy("leaf", "body").agg(F.count("*").alias("n"), F.min("content").alias("content")))

    # A part is open while its lines without a template could still recur; all others' are templates of their own.
    rest, number = bodies.withColumn("part", F.col("leaf")), 0
    while True:
        totals = tables.replace("totals", rest.groupBy("part").agg(F.sum("n").alias("lines"), F.count("*").alias("_n")))
        rest = tables.replace("rest", join_groups(rest, totals, "part", "_n"))
        alone = rest.where(F.col("lines") < documents).select("leaf", "body", F.col("body").alias("template"), F.col("content").alias("text"),
                                                               F.array().cast("array<boolean>").alias("same"))
        still = rest.where(F.col("lines") >= documents)
        if still.isEmpty():
            break
        alone.write.parquet(f"{tables.folder('found')}/round={number}")
        leaders = tables.replace("leaders", _leaders(still))
        joined = join_groups(still.drop("_n", "lines"), leaders, "part", "_n").drop("_n")
        joined = joined.withColumn("tokens", F.split("content", " "))
        joined = joined.withColumn("leader", F.get(F.filter("leaders", lambda x: _joins(F.col("body"), F.col("tokens"), x)), 0))
        joined = tables.replace("joined", joined.drop("leaders", "tokens"))
        tokens, of_leader = F.split("content", " "), F.col("leader.tokens")
        joined.where("leader IS NOT NULL").select(
            "leaf", "body", F.col("leader.body").alias("template"), F.array_join(of_leader, " ").alias("text"),
            F.zip_with(tokens, of_leader, lambda x, y: x == y).alias("same")).write.parquet(f"{tables.folder('found')}/round={number + 1}")
        rest = joined.where("leader IS NULL").select("leaf", "part", "body", "n", "content")
        if number == 0:
            rest = _parts(tables, rest.drop("part"))
        number += 2
    alone.write.parquet(f"{tables.folder('found')}/round={number}")
    found = spark.read.schema(alone.schema).parquet(tables.folder("found")).drop("round")

    # Members of a template are counted per leaf and template; bodies carry the same pair to their lines.
    assigned = lines.join(found.select("leaf", "body", "template"), ["leaf", "body"]).select(
        F.xxhash64("leaf", "template").alias("template_key"), "leaf", "template", "key", "line")
    assigned = tables.replace("assigned", assigned)
    counts = assigned.select("template_key", "leaf", "template", "key").distinct().groupBy("template_key", "leaf", "template").agg(
        F.count("*").alias("documents"))
    sizes = assigned.groupBy("template_key").agg(F.count("*").alias("rows"))
    recurring = tables.replace("recurring", counts.where(F.col("documents") >= documents).join(sizes, "template_key"))
    drop = join_groups(assigned.select("template_key", "key", "line"), recurring.select("template_key", "rows"), "template_key", "rows")

    differing = found.select("leaf", "template", F.posexplode("same").alias("place", "agrees")).where("not agrees").groupBy(
        "leaf", "template").agg(F.collect_set("place").alias("fields"))        # no more places than tokens
    texts = found.groupBy("leaf", "template").agg(F.min("text").alias("text")).join(differing, ["leaf", "template"], "left")
    general = F.array_join(F.transform(F.split("text", " "), lambda x, i: F.when(
        F.array_contains(F.coalesce("fields", F.array().cast("array<int>")), i), F.lit(FIELD)).otherwise(x)), " ")
    report = recurring.select("leaf", "template", "documents").join(texts, ["leaf", "template"]).select(
        "leaf", "template", "documents", general.alias("text"))
    return drop.select("key", "line"), report


def without_recurring(spark: SparkSession, docs: DataFrame, documents: int = 5, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``text`` without the dropped lines, ``n_lines`` (blank ones too) and ``n_dropped``."""
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).alias("_id"), text.alias("text"),
                       F.struct(F.col(id_column).alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("digest")).alias("key"))
    drop, _ = recurring_lines(spark, rows.select("key", "text"), documents)
    gone = drop.distinct().groupBy("key").agg(F.collect_list("line").alias("gone"))          # no more than a document's lines
    joined = rows.join(gone, "key", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    lines = F.split("text", "\n", -1)
    gone = F.array_sort("gone")

    def between(own: Column) -> Column:
        """The runs of lines between those that go; the text is split once and each line taken once."""
        before, after = F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(own)))
        runs = F.zip_with(before, after, lambda a, b: F.struct((a + 2).alias("first"), (b - a - 1).alias("n")))
        return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(own, r["first"], r["n"]))), "\n")

    kept = F.get(F.transform(F.array(lines), between), F.lit(0))
    return joined.select("_id", F.when(F.size("gone") == 0, F.col("text")).otherwise(kept).alias("text"),
                         F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_dropped"))
