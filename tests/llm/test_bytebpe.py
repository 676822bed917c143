import base64
import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tokenloom.llm import bytebpe, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def vocabulary():
    return bytebpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def library(ranks, pattern=public_tokenizers.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    draw = random.Random(3)
    pools = ["abc de'sll\n\t  ", "äöüß éñ 12 3.,;", "日本語テキスト ", "\x00\x1c\x85\xa0 　﻿ a1", "🙂👍🏽́x "]
    made = ["".join(draw.choice(pool) for _ in range(draw.randrange(60))) for pool in pools for _ in range(40)]
    return [None, "", " ", "a" * 70_000, "word " * 60_000, " " * 5_000 + "x", "<|endoftext|> it's", "".join(map(chr, range(1, 800))), *made, "it's", "it's"]


def test_ids_are_the_library_s_and_decode_to_the_text(spark, ranks, vocabulary):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit("x"), "_text": F.lit(1), "bytes": F.lit(2)})
    found = bytebpe.decoded(spark, bytebpe.encoded(spark, docs.repartition(3), vocabulary), vocabulary).collect()
    plain = library(ranks)
    expected = [(i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted(((r["_id"], r["ids"], bytes(r["bytes"])) for r in found), key=repr) == sorted(expected, key=repr)
    assert bytebpe.decoded(spark, bytebpe.encoded(spark, docs.limit(0), vocabulary), vocabulary).collect() == []


def test_bytes_that_are_no_utf8(spark, ranks, vocabulary):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert bytebpe.encoded(spark, docs, vocabulary).first()["ids"] == library(ranks).encode_ordinary("a�b")


def test_a_piece_that_joins_do_not_lead_to_and_ranks_with_gaps(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 301, b"abc": 400, b"wxyz": 500, b"  ": 1000}
    vocabulary = bytebpe.Vocabulary.of_ranks(ranks, r"\S+|\s+")
    rows = [(i, t) for i, t in enumerate(["abc", "wxyz", "wxyzw", "abab  abc", "xabcbc   ", "aab"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = library(ranks, r"\S+|\s+")
    found = bytebpe.decoded(spark, bytebpe.encoded(spark, docs, vocabulary), vocabulary).collect()
    assert {r["_id"]: r["ids"] for r in found} == {i: plain.encode_ordinary(t) for i, t in rows}
    assert {r["_id"]: bytes(r["bytes"]).decode() for r in found} == dict(rows)
    assert len(vocabulary.whole) == 1


def test_decoding_of_nothing_and_of_unknown_ids(spark, vocabulary):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "_id bigint, ids array<int>")
    found = {r["_id"]: r["bytes"] for r in bytebpe.decoded(spark, rows, vocabulary).collect()}
    assert found[1] is None and bytes(found[2]) == b"" and bytes(found[3]) == b'!"'
    for bad in ([50256], [-1], [None]):
        with pytest.raises(Exception, match="an id is"):
            bytebpe.decoded(spark, spark.createDataFrame([(1, bad)], "_id bigint, ids array<int>"), vocabulary).collect()


def test_forgetting_changes_nothing(ranks, vocabulary, monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 3)
    monkeypatch.setattr(bytebpe, "CUTS", 4)
    coder, plain = bytebpe.Coder(vocabulary), library(ranks)
    for text in ("one two three four five six one two one", "one one one two", "seven eight nine ten one two three"):
        assert array("i", coder.encode(text)).tolist() == plain.encode_ordinary(text)


def test_vocabularies_that_cannot_be():
    with pytest.raises(ValueError):
        bytebpe.Vocabulary.of_ranks({b"a": 0}, r"\S+")
    with pytest.raises(ValueError):
        bytebpe.Vocabulary.of_ranks({bytes([b]): b // 2 for b in range(256)}, r"\S+")


def test_query(spark, ranks):
    plain = library(ranks)
    found = queries.op11_byte_bpe(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(found) == len(docs)
    for r in found:
        ids = plain.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
