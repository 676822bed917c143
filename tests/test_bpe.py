import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import codec as cd
from tokenloom.operators import bpe, compare, examples, filters, vocabulary
from tokenloom.plans import pipeline
from tokenloom.sources import sinks

tokenizers = pytest.importorskip("tokenizers")


def library(lines, size, alphabet):
    from tokenizers.models import BPE
    from tokenizers.trainers import BpeTrainer
    made = tokenizers.Tokenizer(BPE(unk_token="<UNK>"))
    made.train_from_iterator(lines, BpeTrainer(vocab_size=size, initial_alphabet=list(alphabet), show_progress=False,
                                               special_tokens=list(bpe.SPECIAL_TOKENS), min_frequency=2))
    return made


def plain_encoding(ids, ranks):
    """Lowest rank first, the leftmost among equals, one merge at a time."""
    ids = list(ids)
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        if not found:
            return ids
        i = min(found)[1]
        ids[i:i + 2] = [ranks[ids[i], ids[i + 1]][1]]


def ranks_of(model):
    return {(a, b): (r, c) for r, (a, b, c) in reversed(list(enumerate(model.merges)))}


def corpus_of(seed, letters):
    rnd = random.Random(seed)
    alphabet = cd.ALPHABET[:letters]
    return alphabet, ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 25))) for _ in range(rnd.randint(5, 30))]


@pytest.fixture(scope="module")
def trained(spark):
    alphabet, lines = corpus_of(5, 4)
    df = spark.createDataFrame([(x,) for x in lines], "unicode string")
    return alphabet, lines, df, bpe.train(bpe.word_counts(df), 2 + 4 + 24, alphabet, keep_steps=5)


def test_training_equals_the_library(trained, spark):
    alphabet, lines, _, model = trained
    other = library(lines, 30, alphabet)
    assert {t: i for i, t in enumerate(model.tokens)} == other.get_vocab()
    for line in lines:
        assert plain_encoding([2 + alphabet.index(c) for c in line], ranks_of(model)) == other.encode(line).ids


def test_tiny_alphabets(spark):
    for seed in (1, 2):
        alphabet, lines = corpus_of(seed, 2)
        df = spark.createDataFrame([(x,) for x in lines], "unicode string")
        model = bpe.train(bpe.word_counts(df), 2 + 2 + 9, alphabet)
        assert {t: i for i, t in enumerate(model.tokens)} == library(lines, 13, alphabet).get_vocab()


def test_encoder_agrees_with_replacements_and_marks_unknown(trained, spark):
    """Merges of new symbols alone may as well be replaced one after another."""
    alphabet, lines, _, model = trained
    df = spark.createDataFrame([("\n".join(lines[i:i + 3]) + "z",) for i in range(len(lines))], "t string")
    columns = [bpe.encode_ids(spark, F.col("t"), model).alias("ids"), bpe.encode_ids(spark, F.col("t"), model, limit=7).alias("cut"),
               bpe.line_sizes(spark, F.split("t", "\n"), model).alias("sizes")]
    assert not model.reuses_ids
    for r in df.select("t", *columns).collect():
        text = "".join(bpe.symbol(2 + alphabet.index(c)) if c in alphabet else c for c in r.t)
        for left, right, new in model.merges:
            text = text.replace(bpe.symbol(left) + bpe.symbol(right), bpe.symbol(new))
        assert r.ids == [max(ord(c) - bpe.SYMBOL_START, bpe.UNKNOWN_ID) for c in text]
        assert r.cut == r.ids[:7] and sum(r.sizes) + r.t.count("\n") == len(r.ids)


def test_tables_that_are_too_long_are_refused(trained, spark, monkeypatch):
    model = trained[3]
    tables = model.vocabulary(spark), model.merge_table(spark)
    monkeypatch.setattr(bpe, "MAX_SYMBOLS", len(model.tokens) - 1)
    with pytest.raises(ValueError):
        bpe.BpeModel.from_tables(*tables)
    id_map = spark.range(cd.MAX_VOCABULARY + 1).select(F.col("id").cast("string").alias("token_id"), F.lit("x").alias("text"))
    with pytest.raises(ValueError):
        vocabulary.readable_lines(tables[0], id_map)
    long = spark.range(cd.MAX_VOCABULARY + 5).select(F.col("id").cast("smallint").alias("token_id"), F.col("id").cast("string").alias("key"))
    ids = spark.createDataFrame([(cd.MAX_VOCABULARY + 4,)], "token_id smallint")
    found = vocabulary.looked_up(ids, long.withColumn("value", F.col("key")))
    assert found.first()["value"] == str(cd.MAX_VOCABULARY + 4)                    # joined whole, not cut


def test_changes_equal_a_recount():
    rnd = random.Random(8)
    for _ in range(60):
        words = [[rnd.randrange(4) for _ in range(rnd.randrange(1, 20))] for _ in range(6)]
        counts = [rnd.randrange(1, 5) for _ in words]
        batch = [(rnd.randrange(4), rnd.randrange(4), new) for new in (7, rnd.choice([2, 8]), 9)] + [(7, rnd.randrange(4), 10)]

        def pairs(found):
            out = Counter()
            for word, n in zip(found, counts):
                for pair in zip(word, word[1:]):
                    out[pair] += n
            return out

        table = bpe.PairTable(batch)
        numbers = dict(zip(table.codes.tolist(), table.numbers.tolist()))
        chain = bpe.Chain(np.array([x for word in words for x in [*word, bpe.GAP]], np.int32), table)
        for left, right, new in batch:
            merged = []
            for word in words:
                i, out = 0, []
                while i < len(word):
                    pair = word[i:i + 2] == [left, right]
                    out.append(new if pair else word[i])
                    i += 1 + pair
                merged.append(out)
            expected = pairs(merged)
            expected.subtract(pairs(words))
            codes, weights = bpe.changes_of(chain, np.array(counts), numbers[left << 32 | right], (left, right, new))
            found = {(code >> 32, code & 0xFFFFFFFF): weight for code, weight in zip(codes.tolist(), weights.tolist())}
            assert found == {k: v for k, v in expected.items() if v}
            words = merged
            assert chain.live().tolist() == [x for word in words for x in [*word, bpe.GAP]]


def test_encoder_against_one_merge_at_a_time():
    """Also for models whose merges give old ids, in which a later merge may make a pair of lower rank."""
    rnd = random.Random(4)
    for reuse in (False, True):
        for _ in range(40):
            merges, known = [], list(range(2, 6))
            for k in range(8):
                new = rnd.choice(known[4:]) if reuse and k and rnd.random() < 0.4 else 6 + k
                merges.append((rnd.choice(known), rnd.choice(known), new))
                known.append(new)
            model = bpe.BpeModel([], merges)
            words = [[rnd.randrange(2, 6) for _ in range(rnd.randrange(0, 25))] for _ in range(7)]
            expected = [plain_encoding(w, ranks_of(model)) for w in words]
            found = [x for part in bpe._Encoder(merges).lists(["".join(map(bpe.symbol, w)) for w in words]) for x in part.to_pylist()]
            assert found == expected
            cut = [x for part in bpe._Encoder(merges).lists(["".join(map(bpe.symbol, w)) for w in words], 3) for x in part.to_pylist()]
            assert cut == [w[:3] for w in found]


def test_training_with_few_pairs_in_the_driver(spark, monkeypatch):
    """Whatever is held, guessed and written in between, the merges are the library's."""
    alphabet, lines = corpus_of(11, 6)
    df = spark.createDataFrame([(x,) for x in lines], "unicode string")
    want = library(lines, 60, alphabet).get_vocab()
    for held, guesses, keep in ((3, 16, 4), (8, 1, 100), (1 << 18, 16, 3)):
        monkeypatch.setattr(bpe, "HELD", held)
        monkeypatch.setattr(bpe, "GUESSES", guesses)
        model = bpe.train(bpe.word_counts(df), 60, alphabet, keep_steps=keep)
        assert {t: i for i, t in enumerate(model.tokens)} == want, (held, guesses, keep)
        assert sum(r.merges for r in model.rounds) == len(model.merges) and max(r.merges for r in model.rounds) <= guesses


def test_rounds_read_only_parts_that_hold_a_pair(spark):
    """Words of one alphabet per part: later merges of one of them open its parts alone."""
    rnd = random.Random(2)
    alphabet = cd.ALPHABET[:16]
    lines = ["".join(rnd.choice(alphabet[k:k + 2]) for _ in range(12)) for k in range(0, 16, 2) for _ in range(12)]
    df = spark.createDataFrame([(x,) for x in lines], "unicode string")
    model = bpe.train(bpe.word_counts(df), 2 + 16 + 60, alphabet, keep_steps=5)
    assert {t: i for i, t in enumerate(model.tokens)} == library(lines, 78, alphabet).get_vocab()
    assert min(r.parts for r in model.rounds) < max(r.parts for r in model.rounds) <= 8
    sizes = {r.parts: r.bytes for r in model.rounds}
    assert sizes[min(sizes)] < sizes[max(sizes)]


def test_sweep_and_totals(trained, spark):
    alphabet, lines, df, model = trained
    words = bpe.word_counts(df)
    swept = {r.vocab_size: r.total_tokens for r in bpe.size_sweep(words, model, [10, 20, 30]).collect()}
    for size in swept:
        part = model.first(size)
        assert swept[size] == bpe.token_totals(df, part).first().tokens
    blank = df.unionByName(spark.createDataFrame([(" ",)], "unicode string"))
    assert bpe.token_totals(blank, model).first().lines == len(lines) + 1
    assert bpe.token_totals(blank, model, count_blank=False).first().lines == len(lines)


def test_model_round_trip(trained, spark, tmp_path):
    model = trained[3]
    sinks.write_model(model, spark, str(tmp_path))
    again = bpe.BpeModel.from_tables(spark.read.parquet(f"{tmp_path}/vocabulary"), spark.read.parquet(f"{tmp_path}/merges"))
    assert again == model


def test_readable_vocabulary(spark):
    c = cd.id_char
    rows = [(0, "<UNK>"), (1, "<PAD>"), (2, c(0)), (3, c(225)), (4, c(225) + c(66) + c(67)), (5, c(106) + c(177))]
    vocab = spark.createDataFrame(rows, "bpe_id int, token string")
    id_map = vocabulary.base_vocabulary(spark).select(F.col("token_id").cast("string").alias("token_id"), F.col("value").alias("text"))
    id_map = id_map.where("token_id <> '177'")
    shown = [r.line for r in vocabulary.readable_lines(vocab, id_map).collect()]
    assert shown == ["<UNK>\t0", "<PAD>\t1", "<EOL>\t2", ' -> ""\t3', 'a + b -> "ab"\t4', 'class + UNK_ID_177 -> "classUNK_ID_177"\t5']
    assert [r.line for r in vocabulary.id_lines(vocab).collect()][3:5] == ["225\t3", "225 66 67\t4"]
    assert vocab.where(filters.is_special(F.col("token"))).count() == 2
    merged = spark.createDataFrame([(0, c(0) + c(1)), (1, c(1)), (2, c(0) + c(1)), (3, c(1) + c(1))], "rank int, token string")
    union = vocabulary.trainer_vocabulary(spark, ["<UNK>"], [c(1), c(0)], merged)
    assert [(r.bpe_id, r.token) for r in union.orderBy("bpe_id").collect()] == [
        (0, "<UNK>"), (1, c(0)), (2, c(1)), (3, c(0) + c(1)), (4, c(1) + c(1))]


def test_examples(spark):
    model = bpe.BpeModel([*bpe.SPECIAL_TOKENS, *cd.ALPHABET])
    files = spark.createDataFrame([(1, "\ue000\n\ue001\n"), (2, " \n"), (3, "\ue002" * 9)], "file_id bigint, unicode string")
    rows = {r.file_id: r for r in examples.build(files, model, 5).collect()}
    assert set(rows) == {1, 3}
    assert (rows[1].input_ids, rows[1].attention_mask, rows[1].labels) == ([2, 0, 3, 1, 1], [1, 1, 1, 0, 0], [2, 0, 3, -100, -100])
    assert rows[3].input_ids == rows[3].labels == [4] * 5 and rows[3].attention_mask == [1] * 5
    assert examples.encoded_files(files, model, keep_newlines=False).where("file_id = 1").first().ids == [2, 3]


def test_published_comparison(spark):
    # The published token counts by vocabulary size.
    sizes = [16384, 15360, 14336, 13312, 12288, 11264, 10240, 9216, 8192, 7168, 6144, 5120, 4096]
    tokens = [5528069, 5609097, 5697169, 5793723, 5900510, 6019657, 6153773, 6306433, 6482521, 6691997, 6947531, 7266977, 7690643]
    series = spark.createDataFrame(list(zip(range(13), sizes, tokens)), "ordinal int, vocab_size int, total_tokens bigint")
    base = spark.createDataFrame([(16384, 7384623)], "vocab_size int, total_tokens bigint")
    better = compare.improvement(series, base).first()
    assert (better.vocab_size, round(better.improvement_pct, 1)) == (16384, 25.1)
    point = compare.nearest(series, base).first()
    assert (point.vocab_size, point.saving_pct) == (5120, 68.75)


def test_extended_vocabulary_encoding(spark):
    files = spark.createDataFrame([(1, "s", "p", "foo bar foo\nclass x")], "file_id bigint, shard string, path string, content string")
    from tokenloom.operators import ranking
    freq = ranking.frequencies(ranking.values(files))
    vocab = vocabulary.extended(vocabulary.base_vocabulary(spark), freq, 1)
    assert vocab.where("token_id >= 226").first().key == "foo"
    assert vocabulary.encode_with(files, vocab).first().ids == [226, 225, 67, 66, 83, 226, 0, 106, 89, 0]


def test_whole_preparation(spark):
    files = spark.createDataFrame([(i, f"part_{i % 4}", f"x/C{i}.java", f"package a;\nclass C{i} {{ int alpha = beta{i % 3}; }}") for i in range(40)],
                                  "file_id bigint, shard string, path string, content string")
    cleaned = pipeline.cleaned_files(files)
    assert cleaned.count() == 40
    made = pipeline.prepare(cleaned, vocab_size=236, sample_percent=50, ratio=0.75, max_length=32)
    assert len(made.model.tokens) == 236 and made.training.count() == 30 and made.evaluation.count() == 10


def test_fragments_lose_no_kept_pair():
    """Cut at rare pairs; of what stays every pair has its count, and equal fragments are one row."""
    words = [[2, 3, 2, 3, 4], [4, 2, 3], [5], [], [2, 3, 2, 3]]
    ids = np.array([x for word in words for x in [*word, bpe.GAP]], np.int32)
    kept = bpe.PairTable([(2, 3, 0), (3, 2, 0)])
    found = bpe.fragments_of(ids, np.array([1, 10, 100, 1000, 10000]), kept).to_pydict()
    assert {tuple(np.frombuffer(i, ">i4").tolist()): n for i, n in zip(found["ids"], found["n"])} == {(2, 3, 2, 3): 10001, (2, 3): 10}
    whole = bpe.fragments_of(ids, np.array([1, 10, 100, 1000, 10000]), None).to_pydict()
    assert sorted(whole["n"]) == [1, 10, 10000]


def test_rounds_read_fragments_instead_of_the_corpus(spark):
    """Lines are all unlike, yet a round reads little of them; equal lines may be one row or many."""
    rnd = random.Random(7)
    alphabet = cd.ALPHABET[:40]
    names = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 4))) for _ in range(60)]
    lines = ["".join(rnd.choices(names, [1 / (i + 1) for i in range(60)], k=60)) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in lines], "unicode string")
    model = bpe.train(bpe.words_of(df), 2 + 40 + 40, alphabet)
    assert {t: i for i, t in enumerate(model.tokens)} == library(lines, 82, alphabet).get_vocab()
    assert max(r.bytes for r in model.rounds) < 4 * sum(map(len, lines)) / 2
    alphabet, lines = corpus_of(3, 2)
    df = spark.createDataFrame([(x,) for x in lines * 3], "unicode string")
    once, often = (bpe.train(words(df), 2 + 2 + 40, alphabet) for words in (bpe.word_counts, bpe.words_of))
    assert once == often and {t: i for i, t in enumerate(once.tokens)} == library(lines * 3, 44, alphabet).get_vocab()


def test_pairs_of_words(spark):
    """Overlaps, astral characters, words of one character, none at all; no pair is a row of its own before it is counted."""
    words = [("aaa", 2), ("ab\U0001F600", 3), ("x", 5), ("", 7), ("aab", 1)]
    df = spark.createDataFrame(words, "word string, n bigint").coalesce(1)
    pairs = bpe.pair_counts(df)
    assert {r.pair: r.cnt for r in pairs.collect()} == {"aa": 5, "ab": 4, "b\U0001F600": 3}
    assert "Generate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert bpe.pair_counts(df.limit(0)).count() == 0


def test_pairs_are_found_by_a_grid_or_by_search(monkeypatch):
    rnd = random.Random(4)
    for grid in (1 << 20, 0):
        monkeypatch.setattr(bpe, "GRID", grid)
        for _ in range(50):
            merges = [(rnd.randrange(9), rnd.randrange(9), 9 + i) for i in range(rnd.randrange(6))]
            ids = np.array([rnd.choice([bpe.GAP, bpe.DEAD, *range(20)]) for _ in range(60)], np.int32)
            numbers = {}
            for number, (left, right, _) in enumerate(merges):
                numbers.setdefault((left, right), number)
            found, own = bpe.PairTable(merges).find(ids[:-1], ids[1:])
            pairs = list(zip(ids.tolist(), ids[1:].tolist()))
            assert dict(zip(found.tolist(), own.tolist())) == {i: numbers[p] for i, p in enumerate(pairs) if p in numbers}


def test_training_reads_the_words_once(spark):
    """The letters come from the pass that spells the words; only letters that were not given take another one."""
    alphabet, lines = corpus_of(3, 5)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    words = spark.createDataFrame([(x, 1) for x in lines], "word string, n bigint").mapInArrow(counted, "word string, n bigint")
    given = bpe.train(words, 2 + 5 + 8, alphabet)
    assert reads.value == len(lines)
    found = bpe.train(words, 2 + 5 + 8, alphabet[:2])
    assert reads.value == 3 * len(lines)
    used = {c for line in lines for c in line} | set(alphabet[:2])
    assert found.alphabet == sorted(used)
    if used == set(alphabet):
        assert given == found


def test_guesses_go_on_from_merges_of_the_same_round(spark):
    """Pairs of ids that a round gives are guessed in that round."""
    words = spark.createDataFrame([("abcdefghijklmnop", 5), ("abcdabcd", 3), ("aaaaaaa", 2)], "word string, n bigint")
    model = bpe.train(words, 2 + 16 + 18, "abcdefghijklmnop")
    assert len(model.merges) >= 15 and len(model.rounds) <= 4
    assert sum(r.merges for r in model.rounds) == len(model.merges)
    lines = [w for w, n in (("abcdefghijklmnop", 5), ("abcdabcd", 3), ("aaaaaaa", 2)) for _ in range(n)]
    assert {t: i for i, t in enumerate(model.tokens)} == library(lines, 2 + 16 + 18, "abcdefghijklmnop").get_vocab()


def test_large_rows_are_written_a_few_at_a_time(spark):
    """Rows of the corpus have megabytes: row groups and pages hold few of them, so that no task needs buffers for all."""
    import pyarrow.parquet as pq
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")          # a word is a row
    try:
        words = spark.createDataFrame([("ab" * 50, 1)] * 30, "word string, n bigint").coalesce(1)
        corpus = bpe._Corpus(words, "ab")
        corpus.merge([(2, 3, 4)])
        blocks = bpe._Words(corpus.fragments(None), 1)
        written = [corpus._corpus, blocks.read(blocks.all_parts())]
        groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for df in written for f in df.inputFiles()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [m.row_group(g).num_rows for m in groups for g in range(m.num_row_groups)]
    assert sum(rows) >= 30 and max(rows) <= 4
    assert not any("DICTIONARY" in e for m in groups for e in m.row_group(0).column(0).encodings)
    corpus.delete()
    blocks.delete()


def test_written_tables_send_little_to_python_at_a_time(spark):
    """A batch has a megabyte or two and not a whole partition of long texts; outside the session's setting stays."""
    from tokenloom import session

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"size": pa.array([batch.nbytes])})

    texts = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    before = spark.conf.get(session.ARROW_BYTES)
    tables = session.Tables(spark)
    found = [r["size"] for r in tables.replace("sizes", texts.mapInArrow(sizes, "size bigint")).collect()]
    assert sum(found) >= 40 << 20 and max(found) <= 3 << 20
    assert spark.conf.get(session.ARROW_BYTES) == before
    tables.delete()


def test_examples_do_not_send_whole_partitions_to_python(spark):
    """The ids are a written table: the plan of the padded columns has no Python in it, and the rows are those of the encoding."""
    alphabet, lines = corpus_of(5, 4)
    model = bpe.train(bpe.word_counts(spark.createDataFrame([(x,) for x in lines], "unicode string")), 2 + 4 + 8, alphabet)
    files = spark.createDataFrame([(i, f"{x}\n{x}") for i, x in enumerate(lines)] + [(99, " \n")], "file_id bigint, unicode string")
    built = examples.build(files, model, 12)
    assert "ArrowEvalPython" not in built._jdf.queryExecution().executedPlan().toString()
    whole = {r.file_id: r.ids for r in examples.encoded_files(files, model).collect()}
    assert {r.file_id: [x for x in r.labels if x != examples.IGNORED_LABEL] for r in built.collect()} == {k: v[:12] for k, v in whole.items()}
