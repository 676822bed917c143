import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import digests, mixing, sharding

LOWER = str.maketrans(digests.UPPER, digests.LOWER)


def test_copies(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 3_000_000), (8, "X" * 3_000_000),
            (2, "aB"), (None, "ab"), (None, "lonely")] + [(100 + i, "copy") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"digest": F.lit(0), "keep_id": F.lit(1)})
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    expected = []
    for doc, text in rows:
        text = (text or "").translate(LOWER)
        keep = max((d for d in groups[text] if d is not None), default=None)
        expected.append((doc, keep, len(groups[text]), doc == keep, hashlib.sha256(text.encode()).hexdigest()))
    found = [tuple(r) for r in digests.mark_copies(spark, docs).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert digests.mark_copies(spark, docs.limit(0)).collect() == []


def test_index_persists_over_batches(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, "doc_id bigint, text string")

    index = digests.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    assert all(r["kept"] for r in digests.mark_copies(spark, batch((1, "a"), (2, "b")), index).collect())
    again = digests.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    found = {r["_id"]: (r["keep_id"], r["kept"]) for r in digests.mark_copies(spark, batch((9, "A"), (10, "c"), (11, "C")), again).collect()}
    assert found == {9: (1, False), 10: (11, False), 11: (11, True)}
    assert again.rows().count() == 3
    again.add(again.rows())                                 # a repeated batch adds nothing
    assert again.rows().count() == 3
    plan = again.rows().select("digest").hint("merge").join(again.rows().hint("merge"), "digest")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_index_grows_and_compacts(spark, tmp_path, monkeypatch):
    """More buckets with more digests, few files a bucket; an attempt that was interrupted counts for nothing."""
    monkeypatch.setattr(digests, "PER_BUCKET", 10)
    monkeypatch.setattr(digests, "FILES", 2)
    folder, seen = tmp_path / "index", {}
    for batch in range(5):
        rows = [(100 * batch + i, f"text {(17 * batch + i) % 60}") for i in range(30)]
        if batch == 3:
            (folder / "000099-2").mkdir()                    # no _SUCCESS
        index = digests.DigestIndex(spark, str(folder), buckets=2)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        found = {r["_id"]: (r["keep_id"], r["kept"]) for r in digests.mark_copies(spark, docs, index).collect()}
        for doc, text in rows:
            seen.setdefault(text, doc)
        assert found == {doc: (seen[text], seen[text] == doc) for doc, text in rows}
        assert index.rows().count() == len(seen) <= index.buckets * digests.PER_BUCKET
        assert [x.name for x in folder.iterdir() if (x / "_SUCCESS").exists()] == [index._generation]
    assert index.buckets == 16 and len(index.rows().inputFiles()) <= digests.FILES * index.buckets
    index.delete()
    assert not folder.exists()


def test_own_index_leaves_nothing(spark):
    before = {t.name for t in spark.catalog.listTables()}
    found = digests.mark_copies(spark, spark.createDataFrame([(1, "a"), (2, "A")], "doc_id bigint, text string"))
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted((r["_id"], r["kept"]) for r in found.collect()) == [(1, False), (2, True)]


def filled(sizes, weights):
    """Water-filling by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        left, share = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / share for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def mix_rows():
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), f"s{i % 5}" if i % 3 else "hot") for i in range(3000)]
    return rows + [(5000, None, "s1"), (5001, "", "none"), (5002, "a b c", None), (5003, "é x\ty", "S"), (None, "n n", "s2")]


def test_mix(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"size": F.lit("x"), "rest": F.lit(0)})
    found = mixing.mixed_rows(spark, docs).collect()
    assert len(found) == len(rows)
    again = mixing.mixed_rows(spark, docs.repartition(3)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    size_of = {r["_id"]: r["size"] for r in found}
    assert size_of[5003] == 2 and size_of[5000] == 0
    sizes = Counter()
    for doc, _, source in rows:
        sizes[source] += size_of[doc]
    target, source_of, taken = filled(sizes, (1, 2, 3)), {d: s for d, _, s in rows}, Counter()
    for r in found:
        source = source_of[r["_id"]]
        assert abs(r["target"] - target[source]) < 1e-6 and r["source_size"] == sizes[source]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[source] += r["taken"]
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 90
    counts = {}
    for r in found:
        if r["size"]:
            counts.setdefault(source_of[r["_id"]], set()).add(r["taken"] // r["size"])
    assert all(max(c) - min(c) <= 1 for c in counts.values())             # whole copies, and one more for the sample
    mixed = mixing.mixture(spark, docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["_id"]: r["copies"] for r in found if r["copies"]})


def chances(rows, rest):
    """Inclusion chances of (weight, size) rows whose expected words are ``rest``; certain ones, one by one, by weight."""
    order, p = sorted(range(len(rows)), key=lambda i: -rows[i][0]), [0.0] * len(rows)
    mass = sum(w * s for w, s in rows)
    while order and rows[order[0]][0] * rest >= mass:
        i = order.pop(0)
        p[i], rest, mass = 1.0, rest - rows[i][1], mass - rows[i][0] * rows[i][1]
    for i in order:
        p[i] = rest * rows[i][0] / mass
    return p


@pytest.mark.parametrize(("column", "weights"), [(None, (19, 20)), ("quality", (2, 3))])
def test_inclusion_rates(spark, column, weights):
    """Copies of each weight class against their chances, within four standard deviations; certain documents always."""
    lengths = [1, 3, 20, 100, 700]
    rows = [(i, "w " * lengths[i % 5], "a" if i < 6000 else "b", [0.5, 1.0, 2.0, 4.5, 60.0][i * 7 // 5 % 5]) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, quality double")
    found = {r["_id"]: r for r in mixing.mixed_rows(spark, docs, weights=weights, weight_column=column).collect()}
    certain = 0
    for source in "ab":
        own = [r for r in rows if r[2] == source]
        target, size = found[own[0][0]]["target"], found[own[0][0]]["source_size"]
        whole = int(target / size)
        weighted = [(r[3] if column else found[r[0]]["size"].bit_length(), found[r[0]]["size"]) for r in own]
        p = chances(weighted, target - whole * size)
        classes = defaultdict(list)
        for r, pair, chance in zip(own, weighted, p):
            classes[pair, chance].append(found[r[0]]["copies"] - whole)
        for (_, chance), taken in classes.items():
            deviation = (chance * (1 - chance) * len(taken)) ** 0.5
            assert abs(sum(taken) - chance * len(taken)) <= 4 * deviation + 1
            certain += chance == 1
        assert len({round(chance, 6) for _, chance in classes}) >= 2
        assert abs(sum(found[r[0]]["taken"] for r in own) - target) <= 350
    assert certain


def test_mix_of_weighted_documents_and_of_nothing(spark):
    rows = [(i, "w " * 10, "a" if i < 1000 else "b", [None, 5.0, float("nan"), -3.0][i % 4]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, quality double")
    found = mixing.mixed_rows(spark, docs, weights=(1, 8), weight_column="quality").collect()
    own = [r for r in found if r["_id"] < 1000]
    assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 10
    assert all(r["copies"] == 0 for r in own if r["_id"] % 4 > 1)
    good, other = (sum(r["taken"] for r in own if r["_id"] % 4 == k) for k in (1, 0))
    assert good > 1.5 * other
    assert mixing.mixed_rows(spark, docs.limit(0)).collect() == []
    assert mixing.mixture(spark, docs.limit(0)).collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert [r["taken"] for r in mixing.mixed_rows(spark, empty).collect()] == [0, 0]


def test_lookup_table():
    names = [f"shard-{i}" for i in range(20)]
    table = sharding.lookup_table(names)
    assert len(table) == sharding.next_prime(2000) and min(table) >= 0
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    # Claims in turn, written plainly.
    preferences = {}
    for name in names:
        h = hashlib.md5(name.encode()).digest()
        offset, skip = int.from_bytes(h[:8], "big") % len(table), int.from_bytes(h[8:], "big") % (len(table) - 1) + 1
        preferences[name] = iter([(offset + j * skip) % len(table) for j in range(len(table))])
    plain = {}
    while len(plain) < len(table):
        for name in sorted(names):
            if len(plain) < len(table):
                plain[next(s for s in preferences[name] if s not in plain)] = name
    assert [names[i] for i in table] == [plain[i] for i in range(len(table))]
    shuffled = names[::-1]
    assert [shuffled[i] for i in sharding.lookup_table(shuffled)] == [names[i] for i in table]
    more = [*names, "shard-20"]
    moved = sum(more[a] != names[b] for a, b in zip(sharding.lookup_table(more)[:2003], table)) if len(table) == 2003 else 0
    assert moved < 2003
    with pytest.raises(ValueError):
        sharding.lookup_table([])
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])


def test_placed(spark, tmp_path):
    rows = [(i, "t") for i in range(5000)] + [(None, None), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"_slot": F.lit(9), "shard": F.lit("old")})
    names = [f"n{i}" for i in range(8)]
    placed = sharding.placed(spark, df, names)
    assert placed.columns == ["doc_id", "text", "_slot", "slot", "shard"]
    found, table = placed.collect(), sharding.lookup_table(names)
    assert len(found) == len(rows)
    for r in found:
        slot = int(hashlib.md5(str("null" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:15], 16) % len(table)
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert max(Counter(r["shard"] for r in found).values()) < 800
    sharding.write_shards(placed, str(tmp_path / "shards"), 2)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert sharding.placed(spark, df.limit(0), names).collect() == []
