import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from test_decontaminate import brute_force as benchmark_hits
from test_exact_mix_shards import filled
from test_jaccard import brute_force as near_groups
from test_language import plain_phrases

from tokenloom.llm import language, mixing, sharding
from tokenloom.llm.queries import SHARDS

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_brute_force(spark):
    """Every stage judged on its own input; the documents' ids are unique here."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10 ** 6, "1 2 3 ?", None, "src1", 7), (10 ** 6 + 1, "слово и дело", None, None, 12),
                                 (10 ** 6 + 2, None, None, None, None)], docs.schema)
    kept = docs.unionByName(odd).cache()
    before = kept.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "decontamination", "source_mix", "sharding"]

    first = stages["language_id"](spark, kept, SMALL)
    assert first.columns == COLUMNS
    model = language.learned(kept.where(language.remainder(kept["doc_id"]) != 2))
    letters = set().union(*("".join(t) for _, t in language.training_sample(
        kept.where(language.remainder(kept["doc_id"]) != 2), "doc_id", "text", "lang")))
    alphabet = {c.lower() for c in letters if c.isalpha()}
    expected = {r["doc_id"] for r in before if (own := [c for c in (r["text"] or "").lower() if c.isalpha()])
                and 2 * sum(c in alphabet for c in own) >= len(own)}
    assert len(alphabet) <= language.LETTERS and model.names
    assert {r["doc_id"] for r in first.collect()} == expected == {r["doc_id"] for r in before} - {r["doc_id"] for r in odd.collect()}

    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    second = stages["ngram_jaccard_join"](spark, first, SMALL).cache()
    assert second.columns == COLUMNS
    assert sorted(r["doc_id"] for r in second.collect()) == [d for d, _, least in near_groups(rows) if d == least]

    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    third = stages["decontamination"](spark, second, SMALL).cache()
    hits = benchmark_hits([(r["doc_id"], r["text"]) for r in second.collect()], items)
    assert third.columns == COLUMNS
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(h[0] for h in hits if not h[5]) and any(h[5] for h in hits)

    fourth = stages["source_mix"](spark, third, SMALL).cache()
    assert fourth.columns == COLUMNS
    size = {r["doc_id"]: r["n"] for r in third.select("doc_id", mixing.word_count(third["text"]).alias("n")).collect()}
    sizes, taken, own = Counter(), Counter(), defaultdict(list)
    for r in third.collect():
        sizes[r["source"]] += size[r["doc_id"]]
        own[r["source"]].append(r["doc_id"])
    copies = Counter(r["doc_id"] for r in fourth.collect())
    for r in third.collect():
        taken[r["source"]] += copies[r["doc_id"]] * size[r["doc_id"]]
    for source, target in filled(sizes, (1, 2, 3)).items():
        assert abs(taken[source] - target) <= max(size[d] for d in own[source]) / 2
    assert max(copies.values()) <= 3

    last = stages["sharding"](spark, fourth, SMALL)
    assert last.columns == [*COLUMNS, "slot", "shard"]
    table = sharding.lookup_table(SHARDS)
    assert Counter(r["doc_id"] for r in last.collect()) == copies
    assert all(table[r["slot"]] == r["shard"] for r in last.collect())


def test_run(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == [*COLUMNS, "slot", "shard"] and found.count() > 0


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b c d e f", None, "s", 1)] * 2 + [(1, "other words in this one here", None, "s", 1), (None, "a b c d e f", None, "s", 1),
            (2, "", None, None, 0), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = sorted((tuple(r)[:2] for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()), key=repr)
    assert found == sorted([(None, "a b c d e f"), (1, "other words in this one here"), (2, ""), (3, None)], key=repr)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).collect() == []


def test_language_stage_rejects_by_the_parse(spark):
    """Text in the known alphabet and in no known language goes; a parse by substring search gives the same rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rng = random.Random(5)
    odd = [(10 ** 6 + n, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz  ", k=300 + n)), None, "src1", 300) for n in range(4)]
    odd += [(10 ** 6 + 4, "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita "
             "ahi quanto a dir qual era cosa dura esta selva selvaggia e aspra e forte", None, "src1", 170), (10 ** 6 + 5, "zq", None, "src1", 2)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    kept = {r["doc_id"] for r in corpus_pipeline.known_languages(spark, docs, SMALL).collect()}
    assert not kept & set(range(10 ** 6, 10 ** 6 + 5)) and 10 ** 6 + 5 in kept
    sample = language.training_sample(docs.where(language.remainder(docs["doc_id"]) != 2), "doc_id", "text", "lang")

    def cost(text, runs):
        own = " " + "".join(c if c.isalpha() else " " for c in " ".join(runs).lower())
        return plain_phrases(text, runs) * math.log2(len(" ".join(own.split())) + 1 + own.endswith(" "))

    limit, phrase = {}, {name: cost("", runs) for name, runs in sample}
    for name, runs in sample:
        rest = [r for n, r in enumerate(runs) if n % language.HELD]
        need = [cost(r, rest) / sum(c.isalpha() for c in r) for r in runs[::language.HELD] if r not in rest]
        limit[name] = language.SPARE * np.quantile(need, language.USUAL)
    for doc in docs.where("n_chars < 400").collect():
        letters = sum(c.isalpha() for c in (doc["text"] or "").lower())
        own = {name: cost(doc["text"] or "", runs) for name, runs in sample}
        win = min(own, key=own.get)
        assert (doc["doc_id"] in kept) == (letters > 0 and own[win] <= limit[win] * letters + language.SLACK * phrase[win]), doc["doc_id"]
