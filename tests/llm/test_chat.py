import hashlib
import random

from pyspark.sql import functions as F

from tokenloom.llm import chat


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        all_ = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(2)
    pieces = ["word ", "\n", "<|end|>\n", "<|turn|>user\n", "</s>", "[INST] ", " ok", "é😀", chat.MARK, chat.MARK + "0", chat.MARK + "a",
              "<|", "|>", "<<SYS>>", "\\", "$1", "  ", "n"]
    rows = []
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 8, 60])):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, "".join(rng.choices(pieces, k=rng.choice([0, 1, 5, 60])))))
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", None), (90, None, "user", "a"), (90, 0, None, "b"), (90, 0, None, "b"),
             (90, 1, "odd\nrole<|", "c"), (91, 0, "assistant", "long " * 100_000), (92, 3, "assistant", ""),
             (93, 0, "system", "s"), (94, 0, "system", "s"), (94, 1, "system", "t"), (94, 2, "assistant", "u")]
    return rows


def test_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"window": F.lit(1), "loss": F.lit("x")})
    for budget, history in ((512, 128), (16, 40), (4, 3)):
        found = {r[0]: tuple(r)[1:5] for r in chat.report(df, budget, history).collect()}
        assert found == expected(rows)
    assert chat.report(df.limit(0)).collect() == []
    probe = {r[0] for r in chat.report(chat.probe(df)).collect()}
    assert -7 in probe


def test_windows(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat.formatted_windows(df, 64, 32).collect()
    by_conv = {}
    for w in windows:
        by_conv.setdefault(w["conv_id"], []).append(w)
    cut = lambda w: w["formatted"].split(chat.CLOSE)[:-1]                    # noqa: E731
    tokens = lambda x: len(x.split("\n", 1)[1].split()) + chat.MARK_TOKENS
    for own in by_conv.values():
        own.sort(key=lambda w: w["window"])
        turns, system = [], cut(own[0])[0] if cut(own[0])[0].startswith(chat.OPEN + "system\n") else None
        for w in own:
            pieces = cut(w)
            old, new = pieces[:w["repeated"]], pieces[w["repeated"]:]
            assert new and (w["tokens"] <= 64 or len(new) == 1)
            if system is not None:
                assert pieces[0] == system                                   # every window begins with it
                old = old[1:] if old else old
            assert len(old) <= len(turns) and (not old or turns[-len(old):] == old)
            assert sum(map(tokens, old)) <= 32
            more = turns[:len(turns) - len(old)][-1:]
            if more and more[0] != system:
                assert sum(map(tokens, old + more)) > 32                      # as many as fit
            turns += new
            start = len("".join(p + chat.CLOSE for p in pieces[:w["repeated"]]))
            assert all(s["start"] >= start for s in w["loss"])


def test_native_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.report(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
