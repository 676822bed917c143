import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import manifest, queries

SMALL = "/root/testdata/sf0.001"


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests, arity):
    """All levels of a tree."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def steps(levels, place, arity):
    """Digests before and after the node, level by level."""
    out = []
    for level in levels[:-1]:
        first = place - place % arity
        out.append((level[first:place], level[place + 1:first + arity]))
        place //= arity
    return out


def plain(rows, arity=2):
    """By hand: rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = climb([leaf(r) for r in groups[name]], arity)
    upper = climb([trees[g][-1][0] for g in names], arity)
    out = []
    for number, name in enumerate(names):
        for place, row in enumerate(groups[name]):
            path = steps(trees[name], place, arity) + steps(upper, number, arity)
            doc, source, lang, size, text = row
            changed = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and size is not None
            found = leaf((doc, source, lang, size + 1, text)) if changed else leaf(row)
            for left, right in path:
                found = h(*left, found, *right)
            root = upper[-1][0]
            out.append((doc, leaf(row), trees[name][-1][0], root, h(*(x for a, b in path for x in [*a, *b])), found, found == root))
    return sorted(out, key=repr)


def corpus(n, langs):
    draw = random.Random(n)
    return [(i, draw.choice(["a", None, "ü"]), draw.choice(langs), draw.choice([None, 5, 2**63 - 1, i]), draw.choice(["x", "", None, "é" * i]))
            for i in range(n)]


COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("rows,arity", [
    (corpus(83, ["de", "en", None, "Z", "z", "é"]) + [(7000, "s", "alone", 1, "t" * 300_000)], 2), (corpus(32, ["one"]), 2),
    ([(5, "s", "l", 1, "same")] * 5 + [(5, "s", "l", 1, "other"), (None, None, None, None, None), (None, "x", None, 2, "")], 2),
    ([(1, "a", None, 3, "only")], 2), (corpus(40, [None, *"abcdef"]), 3)])
def test_against_plain_trees(spark, rows, arity):
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(1) for c in ("place", "tree", "digest", "width", "path", "left")})
    members = manifest.manifest(spark, manifest.tampered_leaves(docs.repartition(3)), arity)
    assert sorted((tuple(r) for r in manifest.verified(members).collect()), key=repr) == plain(rows, arity)


def test_nothing(spark):
    docs = spark.createDataFrame([], COLUMNS)
    found = manifest.verified(manifest.manifest(spark, manifest.tampered_leaves(docs)))
    assert found.collect() == [] and found.columns[0] == "doc_id"
    with pytest.raises(ValueError):
        manifest.manifest(spark, manifest.tampered_leaves(docs), 1)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*manifest.FIELDS).collect()]
    found = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, SMALL).collect()), key=repr)
    assert found == plain(rows)
    assert 0 < sum(not r[-1] for r in found) < len(found) / 3


def test_a_changed_field_changes_leaf_and_root(spark):
    rows = corpus(20, ["a", "b"])
    docs = spark.createDataFrame(rows, COLUMNS)
    before = manifest.manifest(spark, manifest.tampered_leaves(docs)).select("_id", "digest", "root").collect()
    other = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    after = {r["_id"]: r for r in manifest.manifest(spark, manifest.tampered_leaves(other)).select("_id", "digest", "root").collect()}
    assert [r["_id"] for r in before if r["digest"] != after[r["_id"]]["digest"]] == [3]
    assert all(r["root"] != after[r["_id"]]["root"] for r in before)
