import random
import re

from pyspark.sql import functions as F

from tokenloom.llm import jaccard

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    size = min(5, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_force(rows):
    """(id, text) rows: for each its number of shingles and the smallest id reachable, by comparing all pairs."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(s), least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1)).withColumn(
        "shingle", F.lit("x"))
    return sorted(tuple(r) for r in jaccard.shingle_components(spark, docs).collect())


def test_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "Ü"]
    rows, line = [], " ".join(rng.choices(vocabulary, k=12))
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 30, 60, 200]))
        for _ in range(rng.choice([0, 1, 3, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, ("\t" if i % 2 else " ").join(copy) + ("\n" + line if i % 5 == 0 else "")))
        rows.append((len(rows) * 7 % 1009, " ".join(words).upper()))
    assert result(spark, rows) == brute_force(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(250):
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(150)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(copy)))
    assert result(spark, rows) == brute_force(rows)


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(200_000))                      # more than one slice of bytes
    giant = "y" * (3 << 20) + " end"                                       # a word longer than a slice
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one"), (9, "ONE"), (10, "one two three four"),
            (11, "one two three four five"), (12, "one two three four five"), (12, "one two three four five"),
            (13, long), (14, long + " tail"), (15, giant), (16, giant.upper()), (17, "one two three four")]
    assert result(spark, rows) == brute_force(rows)
    assert result(spark, []) == []
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "c")], "doc_id bigint, text string")
    found = sorted((tuple(r) for r in jaccard.shingle_components(spark, docs).collect()), key=repr)
    assert found == sorted([(None, 1, 3), (3, 1, 3), (None, 1, None)], key=repr)
