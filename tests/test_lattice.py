import itertools
import math
import random
from collections import Counter

import pytest

from tokenloom.operators import compare, lattice


def cuts(word):
    for marks in itertools.product((False, True), repeat=max(0, len(word) - 1)):
        ends = [i + 1 for i, m in enumerate(marks) if m] + [len(word)]
        yield [word[a:b] for a, b in zip([0, *ends], ends)]


def best_cut(word, costs):
    """All cuts of the word: least cost, fewer pieces, longer last pieces."""
    dear = max(costs.values()) + lattice.UNKNOWN
    found = []
    for cut in cuts(word):
        if all(p in costs or len(p) == 1 for p in cut):
            found.append((sum(costs.get(p, dear) for p in cut), len(cut), [-len(p) for p in reversed(cut)], cut))
    return min(found)[3]


def plain_costs(counts):
    total = float(sum(counts.values()))
    return {p: math.floor(lattice.UNIT * math.log2(total / c) + 0.5) for p, c in counts.items()}


def plain_learning(words, size, passes):
    found = Counter()
    for word, n in words.items():
        for i in range(len(word)):
            for k in range(1, min(lattice.LONGEST, len(word) - i) + 1):
                found[word[i:i + k]] += n
    characters = {p: c for p, c in found.items() if len(p) == 1}
    longer = sorted((p for p in found if len(p) > 1), key=lambda p: (-found[p] * len(p), p.encode()))
    counts = characters | {p: found[p] for p in longer[:max(0, size - len(characters))]}
    for _ in range(passes):
        costs, used = plain_costs(counts), Counter({p: 0 for p in characters})
        for word, n in words.items():
            used.update({p: n * k for p, k in Counter(best_cut(word, costs)).items()})
        counts = {p: max(c, 1) for p, c in used.items()}
    return plain_costs(counts)


def test_cuts_against_all_cuts():
    rnd = random.Random(3)
    for _ in range(60):
        letters = "abcé𝒳"[:rnd.randrange(2, 6)]
        pieces = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 5))): rnd.randrange(0, 4) * 100 for _ in range(8)}
        words = ["".join(rnd.choice(letters + "z") for _ in range(rnd.randrange(0, 9))) for _ in range(12)]
        trie = lattice.Trie(sorted(pieces.items()))
        number, used, owners = trie.cut(words)
        names = sorted(pieces)
        for i, word in enumerate(words):
            expected = best_cut(word, pieces) if word else []
            assert number[i] == len(expected)
            assert Counter(used[owners == i].tolist()) == Counter(names.index(p) if p in pieces else -1 for p in expected)
    assert lattice.Trie([]).cut(["ab", ""])[0].tolist() == [2, 0]


def test_learning(spark):
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abcd") for _ in range(3)) for _ in range(6)]
    text = " ".join(rnd.choice(stems) + rnd.choice(["", "ing", "s", rnd.choice(stems)]) for _ in range(300))
    files = spark.createDataFrame([(text,), ("\t a \n\n",), ("",), (None,)], "content string")
    words = Counter((text + " a").split())
    counted = lattice.word_counts(files)
    assert {r["word"]: r["n"] for r in counted.collect()} == words
    for size, passes in ((30, 0), (30, 1), (40, 2), (2, 1)):
        learned = lattice.learn(counted, size, passes)
        costs = plain_learning(words, size, passes)
        assert dict(learned) == costs
        total = sum(n * len(best_cut(w, costs)) for w, n in words.items())
        assert lattice.total_tokens(counted, learned).first()["total_tokens"] == total
    assert compare.baseline_totals(files, size=30).first()["total_tokens"] < compare.baseline_totals(files, "characters").first()["total_tokens"]
    assert compare.baseline_totals(files.limit(0)).first()["total_tokens"] == 0


def test_a_vocabulary_that_is_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MAX_PIECES", 3)
    with pytest.raises(ValueError):
        lattice.learn(spark.createDataFrame([("abcd", 1)], "word string, n bigint"), 2)
