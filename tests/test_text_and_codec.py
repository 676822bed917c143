import random

from pyspark.sql import functions as F

from tokenloom.functions import codec as cd
from tokenloom.functions import text as tx


def ids(*numbers):
    return "".join(cd.id_char(i) for i in numbers)


def test_vocabulary_anchors():
    assert cd.BASE_SIZE == 226
    assert [cd.ID_OF[k] for k in ("!LEX_CLASS", "!LEX_STRING_LITERAL", "!LEX_LBRACE", "!LEX_IDENTIFIER", "A")] == [106, 172, 177, 225, 34]


def test_decoding_samples(evaluate):
    assert evaluate(cd.decode, ids(106, 225, 52, 80, 77, 86, 85, 74, 80, 79, 177, 0)) == "class Solution {"
    assert evaluate(cd.decode, ids(225, 52, 73, 66, 83, 70, 69, 49, 83, 70, 71, 70, 83, 70, 79, 68, 70, 84)) == "SharedPreferences"
    assert evaluate(cd.decode, "x" + ids(225, 66) + "\U0001F600" + ids(164, 171, 172, 96)) == "<?>a<?><?>0 'x' \"\" true"
    assert evaluate(cd.decode_id_text, "225 66  225 67 0\n zz 300 -1 106") == "a b\n<?><?><?>class"


def test_one_letter_names_lose_their_marker(evaluate):
    shown = lambda mark: evaluate(lambda c: cd.decode(cd.encode(c, mark)), "catch (Exception e) { éa = x😀; }")
    assert shown(False) == "catch ( Exceptione ) { _a = x__ ; }"
    assert shown(True) == "catch ( Exception e ) { _a = x__ ; }"


def test_private_use_letters_are_ordinary_letters(evaluate):
    assert evaluate(lambda c: cd.char_line_to_ids(cd.encode(c)), "a\ue0e1b") == "225 66 64 67"


def test_decode_inverts_encode(spark):
    rnd = random.Random(3)
    words = ["class", "foo", "Bar2", "{", "}", ";", ">>>=", "true", "non-sealed", "x_1", "::", "\n"]
    texts = [[rnd.choice(words) for _ in range(rnd.randint(1, 25))] for _ in range(200)]
    df = spark.createDataFrame([(" ".join(t),) for t in texts], "c string").select("c", cd.decode(cd.encode(F.col("c"))).alias("d"))
    assert [r for r in df.collect() if r.c.split() != r.d.split()] == []


def test_id_forms(evaluate):
    assert evaluate(cd.id_line_to_chars, " 225 0\t7 ") == ids(225, 0, 7)
    assert evaluate(cd.char_line_to_ids, "z" + ids(225, 0) + "\n") == "225 0"
    assert evaluate(cd.shorts_to_id_text, b"\x00\xe1\x00\x00\xff\xff\x00\x07\x01") == "225 0\n-1 7"
    assert evaluate(cd.cut_at_line_end, ids(1, 2, 0, 3, 0)) == ids(1, 2, 0)
    assert evaluate(cd.cut_at_line_end, ids(1)) == ids(1, 0)


def test_unknown_ids_fail(evaluate):
    import pytest
    with pytest.raises(Exception, match="unknown token id"):
        evaluate(cd.id_line_to_chars, "226")


def test_header(evaluate):
    strip = lambda t: evaluate(lambda c: tx.strip_header(tx.normalize_newlines(c)), t)
    assert strip("// x\r\n\r  package a;\rb\n\n\n") == "  package a;\nb"
    assert strip("important\nx") == "important\nx"
    assert strip("final class A {}\n") == ""
    assert strip("") == ""
    assert strip("class A\n \n") == "class A\n "


def test_line_ends_after_a_header(evaluate):
    strip = lambda t: evaluate(tx.strip_header, t)
    for tail in ("", "\n", "\n\n\n", "\n\nx", "\n\nx\n", "\n \n\n", "\r\n"):
        assert strip("h\nclass A" + tail) == ("class A" + tail).rstrip("\n")
    assert strip("class A" + "\n" * 200_000 + "x" + "\n" * 200_000) == "class A" + "\n" * 200_000 + "x"
    assert strip("\n\n") == "" and strip(None) in (None, "")


def test_names(spark):
    rows = [(1, "src/a/Foo.java"), (2, "Foo.java"), (3, "src/a-b.java"), (4, "x/Größe.java"), (5, "x/" + "a" * 32 + ".java")]
    df = spark.createDataFrame(rows, "id bigint, path string").select(tx.file_name(F.col("path"), F.col("id")).alias("n"))
    names = [r.n for r in df.collect()]
    assert names == ["Foo_1.java", "JavaFile_2_2.java", "JavaFile_3_3.java", "Größe_4.java", "a" * 32 + "_5.java"]
    assert df.where(tx.is_hash_name(F.col("n"))).count() == 1


def test_fill_in_the_middle(spark):
    texts = ["a\nb", "a\nb\nc\n\n", "\n".join(map(str, range(40)))]
    rows = [(k, t) for k in range(50) for t in texts]
    df = spark.createDataFrame(rows, "k bigint, c string").select("c", tx.fill_in_the_middle(F.col("c"), F.col("k")).alias("f"))
    starts = set()
    for r in df.collect():
        if r.c == texts[0]:
            assert r.f == r.c
            continue
        body = r.f.removeprefix("<PRE>")
        prefix, rest = body.split("<MID>")
        middle, suffix = rest.split("<SUF>")
        lines = r.c.rstrip("\n").split("\n")
        assert [x for p in (prefix, middle, suffix) if p for x in p.split("\n")] == lines
        if len(lines) == 40:
            starts.add(len(prefix.split("\n")))
            assert 10 <= len(prefix.split("\n")) < 30 and len(middle.split("\n")) <= 10
    assert len(starts) > 8


def test_stripping(evaluate):
    assert evaluate(lambda c: tx.stripped_lines(c), " a\u00a0\r\n\x0b b \u2028\n c") == ["a", "b", "c"]
    assert evaluate(tx.compact_text, "\t a \r b\n\n") == "a\nb\n"
    assert evaluate(tx.utf16_length, "a\U0001F600é") == 4


def test_texts_are_spelled_as_tokens_are(spark):
    """Nulls, control characters, astral ones, model tokens; texts longer than a run; the columns that a filter sees."""
    texts = ["ab\n_~", "", None, "\x01a", "\x01é", "a\U0001F600é\n", cd.MARKER + "a\x7fb", cd.EOL + "\nx", "�€", "xy" * (cd.RUN // 2)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = df.select("t", cd.spell(F.col("t")).alias("token"), cd.spell_texts(F.col("t")).alias("text")).collect()
    assert all(r.token == r.text for r in rows) and len(rows) == len(texts)
    shown = {r.t: r.text for r in rows}
    assert shown["a\U0001F600é\n"] == ids(cd.ID_OF["a"], *[cd.ID_OF["_"]] * 3) + "\n" and shown[None] is None


def test_a_token_is_cleaned_once(spark):
    """The plan names the cleaning of a token once, not once for each branch that looks at it."""
    from tokenloom.operators import tokens as tk
    pieces = spark.createDataFrame([(1, 0, "foo"), (1, 1, " "), (1, 2, "\ue0e1\u00e9"), (1, 3, "\n")], "file_id int, pos int, text string")
    encoded = tk.encoded_tokens(pieces)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\ufffd") == 1
    assert {r.pos: r.encoded for r in encoded.collect()} == {0: ids(225, *(cd.ID_OF[c] for c in "foo")), 2: ids(225, *[cd.ID_OF["_"]] * 2), 3: cd.EOL + "\n"}


def test_ids_of_many_texts(spark):
    """Null and empty texts, texts without an id, ids of one to three digits, texts longer than a run; the way back by records."""
    texts = [None, "", "z\u00e9\n", ids(0, 9, 10, 99, 100, 225), "z" + ids(7) + "\U0001F600", ids(5) * (cd.RUN // 3), ids(0, 225), ids(*range(226)) * 10000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    columns = [cd.char_line_to_ids(F.col("t")).alias("ids"), cd.to_ids(F.col("t")).alias("list"), cd.shorts_to_id_text(cd.ids_to_shorts(cd.to_ids(F.col("t")))).alias("again")]
    rows = df.select("t", *columns).collect()
    plain = [t if t is None else [ord(c) - cd.PUA_START for c in t if c in cd.ALPHABET] for t in texts]
    assert [r.list for r in rows] == plain
    assert [r.ids for r in rows] == [p if p is None else " ".join(map(str, p)) for p in plain]
    assert [r.again for r in rows] == [p if p is None else "".join(f"{i}\n" if i == 0 else f"{i} " for i in p).strip() for p in plain]
    plan = df.select(*columns)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp" not in plan
    assert df.select(F.explode(cd.to_ids(F.col("t"))).alias("id")).where("id = 99").count() == 10001


def test_encoding_of_texts_full_of_blanks(spark):
    """Blanks are passed over before they are pieces; the code is that of all pieces, one by one."""
    from tokenloom.functions import lexing as lx
    rnd = random.Random(9)
    parts = [" ", "  ", "\t", "\f", "\r", "\n", " \n ", "a", "class", "'", '"', '"x y"', "// c d", "/* e */", "0x1", ".", "...", "non-sealed", "é", "\\", "1.5 "]
    texts = ["", " ", "\n", " \t ", "a  ", *("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 30))) for _ in range(300))]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    pieces = lx.lex_after_blanks(F.col("t"))
    one_by_one = F.array_join(F.transform(lx.lex(cd.without_model_tokens(F.col("t"))), lambda t: cd.encode_token(t)), "")
    for r in df.select("t", pieces.alias("pieces"), cd.encode(F.col("t")).alias("got"), one_by_one.alias("expected")).collect():
        assert r.got == r.expected
        assert not any(p and not p.strip(" \t\r\f") for p in r.pieces)
