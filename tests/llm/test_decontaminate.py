import hashlib
import random
import re

from pyspark.sql import functions as F

from tokenloom.llm import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_force(docs, items):
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, item_text in items:
            w = words(item_text)
            size = min(10, len(w))
            known = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(own) - size + 1):
                if tuple(own[i:i + size]) in known:
                    hit.update(range(i, i + size))
                    found.add("null" if item is None else str(item))
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ünd", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 40])))) for i in range(60)]
    items += [(60, None), (None, items[7][1]), (61, "Only-Three,words")]
    docs = []
    for i in range(80):
        parts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 30, 300])))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(w) + 1)
            parts += ["-".join(w[at:]).upper(), " ".join(w)]
        docs.append((i % 70, rng.choice(["\n", " .. ", ", "]).join(parts)))
    docs += [(100, None), (101, ""), (None, "?!"), (102, items[12][1] + " " + "long " * 400_000 + items[13][1])]
    return docs, items


def frames(spark, docs, items):
    extra = F.lit("x")
    return (spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"items": extra, "item_id": extra}),
            spark.createDataFrame(items, "item_id bigint, text string").withColumn("window", extra))


def test_against_brute_force(spark):
    docs, items = corpus()
    for block in (1 << 20, 150):                  # one broadcast, and several passes
        found = decontaminate.report(spark, *frames(spark, docs, items), block=block)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_force(docs, items)


def test_empty_tables(spark):
    docs, items = frames(spark, [], []), frames(spark, [(1, "a b")], [])
    assert decontaminate.report(spark, *docs).collect() == []
    assert [r["n_words"] for r in decontaminate.report(spark, *items).collect()] == [2]


def test_removal(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, f"é before {item.upper()}, after"), (2, "clean"), (3, None)]
    rows = frames(spark, docs, [(1, item)])
    kept = decontaminate.decontaminated(spark, *rows)
    assert kept.columns == rows[0].columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(spark, *rows, remove="spans").collect()}
    assert cut == {1: "é before , after", 2: "clean", 3: None}


def test_spans_do_not_depend_on_blocks(spark):
    """An item's windows fall into different blocks, yet the whole passage goes; and so with overlapping items."""
    w = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(w[:14])), (2, " ".join(w[8:22])), (3, "x y z")]
    docs = [(1, f"start {' '.join(w[:14])} end of it"), (2, f"Ä {' , '.join(w[:22])}. é"), (3, "x Y\tz x y z"), (4, None), (5, ""), (6, " ".join(w[9:19]))]
    frame, bench = frames(spark, docs, items)
    frame = frame.withColumn("_spans", F.lit(1))
    want = {1: "start  end of it", 2: "Ä . é", 3: "", 4: None, 5: "", 6: ""}
    for block in (2, 6, 1 << 18):
        found = decontaminate.decontaminated(spark, frame, bench, remove="spans", block=block)
        assert found.columns == frame.columns
        assert {r["doc_id"]: r["text"] for r in found.collect()} == want, block
        kept = decontaminate.decontaminated(spark, frame, bench, block=block)
        assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5]
