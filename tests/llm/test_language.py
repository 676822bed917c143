import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tokenloom.llm import language

SMALL = "/root/testdata/sf0.01"


def test_automaton_reads_exactly_the_substrings():
    rng = random.Random(1)
    text = [rng.randrange(3) for _ in range(60)]
    steps = language.suffix_automaton(text)
    known = {tuple(text[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(3000):
        probe = [rng.randrange(3) for _ in range(rng.randrange(9))]
        state = 0
        for symbol in probe:
            state = steps[state].get(symbol) if state is not None else None
        assert (state is not None) == (tuple(probe) in known)


def plain_phrases(text, sample):
    """Greedy longest matches by substring search, in blocks."""
    def symbols(t):
        out = " "
        for c in t.lower():
            c = c if c.isalpha() else " "
            if c != " " or out[-1] != " ":
                out += c
        return out

    own, known, count = symbols(text), symbols(" ".join(sample)), 0
    for at in range(0, len(own), language.BLOCK):
        block, i = own[at:at + language.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j <= len(block) and block[i:j] in known:
                j += 1
            count += 1
            i = max(i + 1, j - 1)
    return count


def test_phrases_against_plain_search():
    rng = random.Random(2)
    make = lambda letters, n: "".join(rng.choices(letters + "  ", k=n))        # noqa: E731
    sample = [("a", [make("abcde", 400), make("abcde", 300)]), ("b", [make("cdefgé", 700)])]
    model = language.learn(sample)
    texts = [make("abcdefgé", n) for n in (0, 1, 5, 300, 2000)] + ["Ab, CD!", "ééé...", "12", "xyz", "ÉÉ ab\n\n\ncd"]
    found, letters, learned = model.phrases(texts)
    for k, (_, runs) in enumerate(sample):
        for i, text in enumerate(texts):
            if text:
                assert found[k, i] == plain_phrases(text, runs), (k, text)
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]
    assert learned[-2] == 0
    one = np.array([model.phrases([t])[0][:, 0] for t in texts if t])
    assert (one == found[:, [bool(t) for t in texts]].T).all()                  # a batch is no different from its texts


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r["doc_id"]: r for r in language.identify(spark, docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert found.keys() == truth.keys()
    held = [d for d in truth if found[d]["held_out"] and truth[d]]
    assert all(found[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in truth)
    assert len(held) > 200 and sum(found[d]["lang_pred"] == truth[d] for d in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    # No prediction depends on the label, source or id of its row.
    moved = docs.withColumn("lang", F.when(language.remainder(F.col("doc_id")) == 2, F.lit("xx")).otherwise(F.col("lang")))
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(spark, moved).collect()} == {d: r["lang_pred"] for d, r in found.items()}


def test_edge_cases(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "uno dos tres", "en" if i % 2 else "es") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", None), (None, "alpha", None), (103, "привет мир", None),
             (104, "alpha " * 400_000, None), (105, "ALPHAİ 𝔘", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"score": F.lit(1), "_text": F.lit("x")})
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark, docs).collect()}
    assert len(found) == len(rows)
    assert [found[i][0] for i in (100, 101, 102)] == ["und"] * 3 and found[100][1] == 0
    assert found[None][0] == found[104][0] == found[105][0] == "en"
    kept = language.in_known_languages(spark, docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(found) - {100, 101, 102, 103}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(spark, none).collect()} == {"und"}
    assert {r["doc_id"] for r in language.in_known_languages(spark, none).collect()} == set(found) - {100, 101, 102}
    assert language.identify(spark, docs.limit(0)).collect() == []


def test_large_alphabets():
    """All letters of the sample are learned, however many; phrases in them are found."""
    rng = random.Random(4)
    words = ["".join(chr(0x4E00 + rng.randrange(900)) for _ in range(6)) for _ in range(200)]
    hangul = ["".join(chr(0xAC00 + rng.randrange(900)) for _ in range(6)) for _ in range(200)]
    sample = [("zh", [" ".join(words)]), ("ko", [" ".join(hangul)])]
    model = language.learn(sample)
    texts = [" ".join(rng.choices(words, k=30)), " ".join(rng.choices(hangul, k=30)), words[0] + "ж" + hangul[0]]
    found, letters, learned = model.phrases(texts)
    assert found.tolist() == [[plain_phrases(t, runs) for t in texts] for _, runs in sample]
    assert letters.tolist() == [180, 180, 13] and learned.tolist() == [180, 180, 12]
    assert [x[0] for x in model.best(texts[:2])] == ["zh", "ko"]


def test_sample_size(spark):
    docs = spark.range(150).selectExpr("id AS doc_id", "concat('some words ', id) AS text", "'en' AS lang")
    assert [(lang, len(runs)) for lang, runs in language.training_sample(docs, "doc_id", "text", "lang")] == [("en", 96)]
