"""WARC (5): archives of pages, written and read back by boundary-chain verification.

Writing: one record per page, by Spark's own text writer, whose committer copes with lost executors.  The payload is the
page in UTF-8.  Of pages with equal payloads the one with the largest id is a response record; the others are revisit
records without body that refer to it.

Reading: files are split at any byte range.  Every occurrence of the magic ``WARC/1.1`` line is a candidate record, and
its headers name its successor's offset.  Within a split the chains are followed to the first offset beyond it; across
splits pointers are doubled from the file start.  Only records reached from the file start count, so a magic inside a
payload is part of that payload.  Offsets come from byte counts alone: no split needs to know what precedes it.

Defined cases: a null page counts as empty; a null url is left out of the headers, and control characters in it are
percent-encoded; a null id is the largest of none, and reads back as null; rows that repeat an id and a payload are the
same type of record; payloads may hold anything; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.skew import join_groups
from tokenloom.session import Tables, shared_folder

# Fixed values of the format.
MAGIC, END, PROFILE = "WARC/1.1\r\n", "\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
FEW = 1_000_000              # revisits whose ids are broadcast; more are joined by a shuffle


def base32_sha1(payload: Column) -> Column:
    """Each five of the forty hex digits are four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _name(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 0, id_column: str = "page_id",
                   url_column: str = "url", html_column: str = "html") -> None:
    tables = Tables(spark)
    body = F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    pages = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), body.alias("body"))
    pages = pages.withColumn("bytes", F.octet_length("body").cast("bigint")).withColumn("digest", base32_sha1(F.col("body").cast("binary")))
    digests = tables.replace("digests", pages.select("id", "digest", "bytes"))
    groups = digests.groupBy("digest", "bytes").agg(F.max("id").alias("refers"), F.count("*").alias("copies"))
    groups = tables.replace("groups", groups.where((F.col("copies") > 1) & (F.col("bytes") >= least_bytes)).drop("bytes"))
    revisits = join_groups(digests.select("id", "digest"), groups, "digest", "copies").where(
        ~F.col("id").eqNullSafe(F.col("refers"))).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers").distinct()
    revisits = tables.replace("revisits", revisits)
    own = F.broadcast(revisits) if revisits.count() <= FEW else revisits
    rows = pages.join(own, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    again = F.col("refers").isNotNull()
    url = F.col("url")
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))          # noqa: E731
    headers = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _name(F.col("id"))), line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Refers-To", _name(F.col("refers"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        F.lit("Content-Length: "), F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string")), F.lit(END))
    # The writer ends every row with the record end; a file is a plain sequence of records.
    rows.select(F.concat(headers, F.when(again, F.lit("")).otherwise(F.col("body"))).alias("value")).write.option(
        "lineSep", END).text(folder)


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between magics, with its split and its order there."""
    read = spark.read.option("lineSep", MAGIC).text(folder)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("place"), "value")


def _header(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _candidates(chunks: DataFrame) -> DataFrame:
    """One small row per chunk: its length, its headers, and the digest of its payload if it holds all of that."""
    found = chunks.withColumn("head", F.concat(F.substring_index("value", END, 1), F.lit("\r\n")))
    found = found.withColumn("head_bytes", F.octet_length("head").cast("bigint") + len(END) - 2).withColumn(
        "body_bytes", F.expr("try_cast(regexp_extract(head, '(?im)^Content-Length:[ \\\\t]*([0-9]+)', 1) AS BIGINT)"))
    found = found.withColumn("bytes", F.octet_length("value").cast("bigint"))
    whole = F.col("head_bytes") + F.col("body_bytes") + len(END) == F.col("bytes")
    payload = F.col("value").cast("binary").substr(F.col("head_bytes").cast("int") + 1, F.col("body_bytes").cast("int"))
    return found.select("file", "block", "place", "bytes", "head_bytes", "body_bytes", F.when(whole, base32_sha1(payload)).alias("sha1"),
                        *(_header(n).alias(c) for n, c in (
                            ("WARC-Type", "type"), ("WARC-Record-ID", "record"), ("WARC-Refers-To", "refers"),
                            ("WARC-Payload-Digest", "digest"), ("X-Payload-Length", "full_bytes"), ("WARC-Target-URI", "url"))))


def _with_offsets(chunks: DataFrame, size: str) -> DataFrame:
    """Add ``start``, the offset of the magic before each chunk (negative for what precedes the first one).  Bytes are
    summed up within splits, then over the splits of a file."""
    length = F.col(size) + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunks.groupBy("file", "block").agg(F.sum(length).alias("_all"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "block", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_base"))
    return chunks.withColumn("_in", F.coalesce(F.sum(length).over(inside), F.lit(0))).join(totals, ["file", "block"]).withColumn(
        "start", F.col("_base") + F.col("_in") - len(MAGIC)).drop("_base", "_in")


def _exits(split: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split the first offset of its chain that is no candidate of the split."""
    split = split.sort_values("start")
    start, after = split["start"].to_numpy(), split["after"].to_numpy()
    at = np.searchsorted(start, after)
    leaves = after.copy()
    for i in range(len(start) - 1, -1, -1):            # successors lie behind, so they are settled first
        if at[i] < len(start) and start[at[i]] == after[i]:
            leaves[i] = leaves[at[i]]
    return pd.DataFrame({"file": split["file"], "block": split["block"], "start": start, "exit": leaves})


def _reached(split: pd.DataFrame) -> pd.DataFrame:
    """Mark the candidates on the chain from the split's entry; ``owner`` is the record that a chunk lies in, null if it
    began in an earlier split."""
    split = split.sort_values("start")
    start, after = split["start"].to_numpy(), split["after"].to_numpy()
    at, chain = np.searchsorted(start, after), []
    entry = split["entry"].iloc[0]
    if not pd.isna(entry):
        i = int(np.searchsorted(start, int(entry)))
        while i < len(start) and (not chain or start[i] == after[chain[-1]]):
            chain.append(i)
            i = int(at[i])
    owner = pd.Series(pd.NA, index=range(len(start)), dtype="Int64")
    if chain:
        place = np.searchsorted(chain, np.arange(len(start)), "right") - 1
        owner[place >= 0] = start[np.array(chain)[place[place >= 0]]]
    return pd.DataFrame({"file": split["file"].to_numpy(), "block": split["block"].to_numpy(), "start": start, "owner": owner})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record reached from its file's start: ``record``, ``type``, ``payload_bytes`` and ``payload_digest``
    of the payload as read (a revisit's are those of its headers), ``refers``, ``url``, and ``intact`` (the digest agrees)."""
    tables = Tables(spark)
    candidates = tables.replace("chunks", _candidates(_chunks(spark, folder)))
    candidates = _with_offsets(candidates, "bytes").withColumn("after", F.coalesce(
        F.col("start") + len(MAGIC) + F.col("head_bytes") + F.col("body_bytes") + len(END), F.lit(-1)))
    candidates = tables.replace("candidates", candidates.where("start >= 0"))
    links = candidates.select("file", "block", "start", "after")
    exits = tables.replace("exits", links.groupBy("file", "block").applyInPandas(
        _exits, "file string, block bigint, start bigint, exit bigint"))

    # Across splits: only candidates that some chain enters matter, besides the file starts.
    entered = exits.select("file", F.col("exit").alias("start")).distinct()
    jumps = tables.replace("jumps", exits.join(entered, ["file", "start"]).unionByName(exits.where("start = 0")).select(
        "file", "start", "exit").distinct())
    reached = tables.replace("reached", jumps.where("start = 0").select("file", "start"))
    known = reached.count()
    while True:
        further = reached.join(jumps, ["file", "start"]).select("file", F.col("exit").alias("start")).join(
            jumps.select("file", "start"), ["file", "start"])
        reached = tables.replace("reached", reached.unionByName(further).distinct())
        if (now := reached.count()) == known:
            break
        known = now
        second = jumps.select("file", F.col("start").alias("exit"), F.col("exit").alias("_to"))
        jumps = tables.replace("jumps", jumps.join(second, ["file", "exit"], "left").select(
            "file", "start", F.coalesce("_to", "exit").alias("exit")))

    entries = links.join(reached, ["file", "start"]).groupBy("file", "block").agg(F.min("start").alias("entry"))
    marked = tables.replace("marked", links.join(entries, ["file", "block"], "left").groupBy("file", "block").applyInPandas(
        _reached, "file string, block bigint, start bigint, owner bigint"))
    records = candidates.join(marked.where("owner = start").select("file", "start"), ["file", "start"])
    records = tables.replace("records", records)
    split_payloads = records.where("sha1 is null and type != 'revisit' and body_bytes is not null")
    if split_payloads.limit(1).count():
        again = _joined(spark, tables, folder, marked, split_payloads)
        records = records.join(again, ["file", "start"], "left").withColumn("sha1", F.coalesce("sha1", "_sha1"))
    revisit = F.col("type") == "revisit"
    written = F.regexp_replace("digest", "^sha1:", "")
    return records.select(
        "record", "type", F.when(revisit, F.expr("try_cast(full_bytes AS BIGINT)")).otherwise(F.col("body_bytes")).alias("payload_bytes"),
        F.when(revisit, written).otherwise(F.col("sha1")).alias("payload_digest"), "refers", "url",
        (revisit | (written == F.col("sha1"))).alias("intact"))


def _joined(spark: SparkSession, tables: Tables, folder: str, marked: DataFrame, split_payloads: DataFrame) -> DataFrame:
    """Digests of the payloads that hold a magic: their chunks are read again and put together."""
    last = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = marked.groupBy("file", "block").agg(F.max("owner").alias("_last"))
    lasts = lasts.select("file", "block", F.last("_last", True).over(last).alias("_earlier"))
    owners = marked.join(lasts, ["file", "block"]).select("file", "block", "start", F.coalesce("owner", "_earlier").alias("owner"))
    wanted = owners.join(split_payloads.select("file", F.col("start").alias("owner"), "head_bytes", "body_bytes"), ["file", "owner"])
    wanted = tables.replace("wanted", wanted)
    files = wanted.select("file").distinct()
    chunks = _chunks(spark, folder).join(files, "file", "left_semi").withColumn("bytes", F.octet_length("value").cast("bigint"))
    found = _with_offsets(chunks, "bytes").join(wanted.drop("block"), ["file", "start"])
    whole = found.groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"), F.first("head_bytes").alias("head_bytes"),
        F.first("body_bytes").alias("body_bytes"))
    data = F.array_join("parts.value", MAGIC).cast("binary")
    payload = data.substr(F.col("head_bytes").cast("int") + 1, F.col("body_bytes").cast("int"))
    return whole.select("file", F.col("owner").alias("start"), base32_sha1(payload).alias("_sha1"))


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back: one row per page."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark, pages, folder, least_bytes)

    def page(column: str) -> Column:
        return F.expr(f"try_cast(nullif(regexp_extract({column}, '<urn:page:(.*)>', 1), '') AS {pages.schema['page_id'].dataType.simpleString()})")

    return read_archives(spark, folder).select(
        page("record").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page("refers").alias("refers_to"))
