import base64
import hashlib
import random

from pyspark.sql import functions as F

from tokenloom.llm import warc

RECORD = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{0}>\r\nWARC-Payload-Digest: sha1:X\r\n"
          "X-Payload-Length: 3\r\nContent-Length: {1}\r\n\r\n")


def payloads():
    rng = random.Random(4)
    inner = RECORD.format(777, 5) + "hello\r\n\r\n"
    rows = [(i, f"http://x/{i}", "é" * rng.randrange(2000)) for i in range(60)]
    rows += [(100, "u", inner), (101, None, "before\r\n\r\n" + inner * 3 + "after"), (102, "u\r\nX: y", "WARC/1.1\r\n"),
             (103, "u", "\r\n\r\nWARC/1.1\r\nWARC/1.1\r\nContent-Length: 99999999999\r\n\r\n"), (104, "u", None), (105, "u", ""),
             (106, "u", "same"), (107, "u", "same"), (108, "u", "Same"), (107, "u", "same"), (None, "u", "same"), (None, "u", "other"),
             (109, "u", "big " * 300_000 + inner + "tail " * 300_000), (110, "u", inner)]
    return rows + [(1000 + i, "u", "copy") for i in range(2000)]


def expected(rows, least=0):
    groups = {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        last = max((p for p in groups[body] if p is not None), default=None)
        revisit = len(groups[body]) > 1 and len(body) >= least and last is not None and page != last
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response",
                    last if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = payloads()
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"digest": F.lit(1), "file": F.lit("x")})
    for least in (0, 5):
        found = sorted((tuple(r) for r in warc.round_trip(spark, pages.repartition(3), least).collect()), key=repr)
        assert found == expected(rows, least)
    assert warc.round_trip(spark, pages.limit(0)).collect() == []


def test_splits(spark, tmp_path):
    """Files cut at any byte: records and payloads reach over several splits."""
    rows = payloads()
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = str(tmp_path / "warc")
    warc.write_archives(spark, pages.coalesce(1), folder)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("20011", "1000003"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = warc.read_archives(spark, folder).collect()
            assert len(found) == len(rows) and all(r["intact"] for r in found)
            assert sorted((r["payload_bytes"], r["payload_digest"]) for r in found) == sorted(x[1:3] for x in expected(rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_damage(spark, tmp_path):
    """What follows a broken length is not reached; a wrong digest is reported."""
    good = [RECORD.format(i, 3) + "abc\r\n\r\n" for i in range(4)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.txt").write_bytes("".join([*good[:2], RECORD.format(9, 50) + "short\r\n\r\n", *good[2:]]).encode())
    found = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(r["record"] for r in found) == ["<urn:page:0>", "<urn:page:1>", "<urn:page:9>"]
    assert not any(r["intact"] for r in found)
