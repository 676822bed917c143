import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tokenloom.llm import templates


def brute_force(rows, documents, bodies):
    """The tree, leaf by leaf.  ``bodies`` breaks ties between equally frequent lines as the operator does."""
    lines = []
    for key, text in {(d, t or "") for d, t in rows}:
        for number, line in enumerate(text.split("\n")):
            tokens = tuple(templates.FIELD if re.search("[0-9]", t) else t for t in line.split())
            if tokens:
                lines.append(((key, text), number, tokens))
    leaves = defaultdict(Counter)
    for _, _, tokens in lines:
        leaves[len(tokens), tokens[:templates.DEPTH]][tokens] += 1
    owner = {}
    for leaf, counts in leaves.items():
        left = dict(counts)
        while left:
            leader = max(left, key=lambda t: (left[t], bodies[" ".join(t)]))
            joined = [t for t in left if sum(a == b for a, b in zip(t, leader)) >= templates.AGREE * len(t)]
            for t in joined:
                owner[t] = leader
                del left[t]
    seen = defaultdict(set)
    for key, _, tokens in lines:
        seen[owner[tokens]].add(key)
    drop = {(key, number) for key, number, tokens in lines if len(seen[owner[tokens]]) >= documents}
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [p for i, p in enumerate(parts) if ((doc, text or ""), i) not in drop]
        out.append((doc, None if text is None else "\n".join(kept), len(parts) if text is not None else 0, len(parts) - len(kept)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(7)
    rows = []
    for i in range(120):
        lines = [f"user {rng.randrange(99)} logged in from host{rng.randrange(9)} at noon", f"page {i} of 120",
                 f"see also the {rng.choice('abcdefgh')} {rng.choice('xyz')} page {rng.choice('uvw')} today",
                 " ".join(rng.choices("red green blue dark light old new".split(), k=rng.randrange(1, 6))), "", "  ",
                 "own words " + " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}" * 3 for _ in range(9))]
        rng.shuffle(lines)
        rows.append((i % 110, "\n".join(lines[:rng.randrange(8)])))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "lone line"), (204, "lone line"), (204, "lone line"), (None, "page 3 of 4\nrest is kept here"),
             (205, "long " * 300_000), (206, "\n".join(f"page {i} of {i}" for i in range(3000)) + "\nthe end comes here")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"key": F.lit(1), "line": F.lit("x"), "gone": F.lit(0)})
    tokens = docs.select(F.explode(F.split("text", "\n", -1)).alias("l")).select(templates.masked(
        F.filter(F.split("l", r"\s+"), lambda x: x != "")).alias("t")).select(F.array_join("t", " ").alias("t"), F.xxhash64("t").alias("h"))
    bodies = {r["t"]: r["h"] for r in tokens.collect()}
    for documents in (2, 5):
        found = sorted((tuple(r) for r in templates.without_recurring(spark, docs, documents).collect()), key=repr)
        assert found == brute_force(rows, documents, bodies)
    assert templates.without_recurring(spark, docs.limit(0)).collect() == []


def test_general_form(spark):
    rows = [(i, f"closed connection from {name} by peer after {i} s") for i, name in enumerate(["ann", "bob", "cyd", "dan", "eve"])]
    docs = spark.createDataFrame(rows, "key bigint, text string")
    _, found = templates.recurring_lines(spark, docs, 3)
    assert [(r["documents"], r["text"]) for r in found.collect()] == [(5, "closed connection from <*> by peer after <*> s")]


def every_template(lines, documents):
    """The numbers of the lines to drop, each leaf to its end; ``lines`` holds (document, text), each text once a document."""
    leaves = defaultdict(list)
    for number, (_, line) in enumerate(lines):
        tokens = tuple(templates.FIELD if re.search("[0-9]", t) else t for t in line.split())
        leaves[len(tokens), tokens[:templates.DEPTH]].append((tokens, number))
    drop = set()
    for own in leaves.values():
        counts = Counter(t for t, _ in own)
        while own:
            leader = max((t for t, _ in own), key=lambda t: counts[t])
            joined = [x for x in own if sum(a == b for a, b in zip(x[0], leader)) >= templates.AGREE * len(leader)]
            own = [x for x in own if x not in joined]
            if len({lines[number][0] for _, number in joined}) >= documents:
                drop |= {number for _, number in joined}
    return drop


def test_leaf_with_many_templates(spark):
    """Each line begins with date, time and number, so all are one leaf; the varying place holds no digit."""
    rng, kinds = random.Random(3), 2 * templates.LEADERS + 20
    name = lambda n: "".join(chr(97 + (n // 26 ** i) % 26) for i in range(4))     # noqa: E731
    lines = []
    for kind in range(kinds):
        w = [f"{name(kind)}{x}" for x in "abcde"]
        for doc in rng.sample(range(60), 6 if kind % 3 else 3):                  # every third one stays below five documents
            lines.append((doc, f"2024-01-{doc} 10:{kind} 77 {w[0]} {w[1]} {name(1000 + len(lines))} {w[2]} {w[3]} {w[4]}"))
    docs = spark.createDataFrame(lines, "doc_id bigint, t string").groupBy("doc_id").agg(
        F.array_join(F.collect_list("t"), "\n").alias("text"))
    found = {r["_id"]: r["text"] for r in templates.without_recurring(spark, docs).collect()}
    kept = sorted(line for text in found.values() for line in text.split("\n") if line)
    gone = every_template(lines, 5)
    assert kept == sorted(line for number, (_, line) in enumerate(lines) if number not in gone)
    assert len(gone) > 2 * 6 * templates.LEADERS * 2 // 3 - 12


def test_lines_without_constants_and_short_lines(spark):
    """Numbers, links and lines with one beginning stay unless the line itself recurs."""
    texts = [f"http://x/{i}\n{i} {i + 1} 0.{i}\n12 13\nthe old man {w}\nthe old man {w} {v}\n<*> {i}\n{i} {i} {i} {i} {i} {w}\npage {i} of 9"
             for i, (w, v) in enumerate(zip("sleeps walks reads eats sings waits".split(), "here now alone well there long".split()))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["_id"]: r["text"].split("\n") for r in templates.without_recurring(spark, docs).collect()}
    assert found == {i: [line for n, line in enumerate(t.split("\n")) if n not in (2, 7)] for i, t in enumerate(texts)}


def test_documents_of_very_many_lines(spark):
    """A text is split once, so the time grows with its lines."""
    import time
    rows = [(i, "\n".join([f"own {i} line {k} of {chr(97 + k % 26)} {chr(97 + i)}" if k % 2 else "the very same line" for k in range(60_000)])) for i in range(5)]
    docs = spark.createDataFrame([*rows, (9, "\nthe very same line\n")], "doc_id bigint, text string")
    start = time.perf_counter()
    found = {r["_id"]: r for r in templates.without_recurring(spark, docs).collect()}
    assert time.perf_counter() - start < 120
    assert (found[9]["text"], found[9]["n_lines"], found[9]["n_dropped"]) == ("\n", 3, 1)
    assert all("the very same line" not in found[i]["text"] and found[i]["n_lines"] == 60_000 for i in range(5))
    assert all(len(found[i]["text"].split()) / 8 <= 60_000 - found[i]["n_dropped"] for i in range(5))


def test_parts_of_large_leaves(spark, monkeypatch):
    """The same lines go whether leaves are cut into parts or not."""
    rng = random.Random(11)
    words = [["w" + c for c in "abcdefghijklmnopqrst"[:n]] for n in (2, 3, 8, 20)]
    lines = [" ".join(["log", "from", "host", *(rng.choice(words[(p + size) % 4]) for p in range(size))])
             for size in (0, 1, 2, 3, 6, 9, 25) for _ in range(150)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::40])) for i in range(40)], "doc_id bigint, text string")
    found = []
    for leaders in (60, 100_000):
        monkeypatch.setattr(templates, "LEADERS", leaders)
        found.append(sorted((tuple(r) for r in templates.without_recurring(spark, docs).collect())))
    assert found[0] == found[1] and 0 < sum(r[3] for r in found[0]) < len(lines)


def test_many_unlike_lines_take_few_rounds(spark, monkeypatch):
    """100,000 unlike lines, and 2,000 templates of five lines each, in one leaf."""
    rng, rounds, leaders_of = random.Random(5), [], templates._leaders
    name = lambda n: "".join(chr(97 + (n // 26 ** i) % 26) for i in range(5))     # noqa: E731
    lines = [f"log from host {i} " + " ".join(name(rng.randrange(26 ** 5)) for _ in range(5)) for i in range(100_000)]
    kinds = [[name(rng.randrange(26 ** 5)) for _ in range(4)] for _ in range(2_000)]
    rows = [(i, "\n".join(lines[i::50] + [f"log from host {i} {' '.join(k)} {name(rng.randrange(26 ** 5))}" for k in (kinds if i < 5 else [])]))
            for i in range(50)]
    monkeypatch.setattr(templates, "_leaders", lambda bodies: rounds.append(1) or leaders_of(bodies))
    found = templates.without_recurring(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(rounds) <= 5
    assert {r["_id"]: r["n_dropped"] for r in found} == {i: 2_000 if i < 5 else 0 for i in range(50)}
