"""The one-pattern lexer against a lexer that tries every rule at every position and keeps the longest match."""

import random

import regex
from pyspark.sql import functions as F

from tokenloom.functions import lexing as lx
from tokenloom.operators import tokens as tk

FRAGMENTS = ["'", '"', '"""', "\n", "\\", "\\u005c", "a", "é", "\U0001F600", "0", "0x", "1F", "1_0", ".", "..", "e5", "L", "f", "/", "/*", "*/",
             "//", " ", "non-sealed", "class", "@", "@interface", "true", ">>>=", ">", "=", "-", "->", "::", "{", "}", "#", "\t", "\r\n", "0b1",
             "p3", "\\n", "\\'", "$x"]


def to_python(pattern):
    return regex.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: rf"\U{int(m[1], 16):08X}", pattern)


RULES = ([(k.upper().replace("-", "_"), regex.escape(k)) for k in lx.KEYWORDS]
         + [("BOOL_LITERAL", "true|false"), ("NULL_LITERAL", "null")]
         + [(n, regex.escape(s)) for n, s in lx.SYMBOLS.items()]
         + [("STRING_LITERAL", to_python(lx.string_rule(False)))] + [(n, to_python(p)) for n, p in lx.RULES.items()])
ORDER = {name: no for no, name, _, _ in lx.TOKEN_TYPES}
COMPILED = [(n, regex.compile(p)) for n, p in RULES]


def longest(text, at):
    """(end, type) of the longest token at a position; the earlier rule wins a tie."""
    best = (at, "")
    for name, rule in COMPILED:
        # Greedy alternation need not give the longest match of a rule, so ask for every end.
        end = max((m for m in [rule.match(text, at)] if m), key=lambda m: m.end(), default=None)
        if end and (end.end() > best[0] or (end.end() == best[0] and ORDER[name] < ORDER.get(best[1], 999))):
            best = (end.end(), name)
    return best


def slow_lex(text):
    out, at = [], 0
    while at < len(text):
        end, name = longest(text, at)
        if end == at:
            # The failed prefix and one more character are dropped; only quotes have a prefix.
            piece = regex.compile(to_python("|".join(lx.token_pattern(False).split("|")[-1:]))).match(text, at)
            tail = regex.compile(to_python(rf"'(?:[^'\\\r\n]|{lx.ESCAPE}|\\)?[\s\S]?|" + lx._string_body(lx.ESCAPE, False) + r"\\?[\s\S]?"))
            piece = tail.match(text, at) if text[at] in "'\"" else piece
            at = piece.end()
        else:
            out.append((name, text[at:end]))
            at = end
    return out


def test_fixed_tables():
    assert len(lx.TOKEN_TYPES) == 128
    anchors = {"CLASS": 9, "NON_SEALED": 66, "DECIMAL_LITERAL": 67, "LPAREN": 78, "AT": 123, "WS": 125, "IDENTIFIER": 128}
    assert {k: lx.TYPE_NO[k] for k in anchors} == anchors


def test_random_texts_match_the_slow_lexer(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(FRAGMENTS) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id bigint, content string")
    found = {i: [] for i in range(len(texts))}
    for r in tk.tokens(files).orderBy("file_id", "pos").collect():
        found[r.file_id].append((r.token_type, r.text))
    # An escaped quote written with the backslash's own code is read greedily; such texts are left to the oracle.
    wrong = [(t, found[i], slow_lex(t)) for i, t in enumerate(texts) if "\\u005c" not in t and found[i] != slow_lex(t)]
    assert not wrong[:3]


def test_pieces_add_up_to_the_text(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(FRAGMENTS) for _ in range(20)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    assert df.where(F.array_join(lx.lex(F.col("content")), "") != F.col("content")).count() == 0


def test_long_literals_do_not_exhaust_the_stack(evaluate):
    for text in ('"' + "\\n" * 200_000 + '"', '"' + "\\n" * 200_000, "/*" + "x" * 300_000 + "*/", "a" * 300_000):
        assert evaluate(lambda c: F.size(lx.lex(c)), text) == 1


def test_comments_and_text_blocks_end_where_the_lazy_rule_ends(spark):
    """The JVM form tries no end at each character; a comment of a megabyte is one step of a loop for each star."""
    assert "*?" not in lx.TOKEN_PATTERN
    draw = random.Random(11)
    texts = ["".join(draw.choice(["/*", "*/", "*", "/", "**", '"', '""', '"""', '"""\n', "\r", " ", "a", "é", "\\"]) for _ in range(40))
             for _ in range(1500)] + ["/**/x/***/y/*/", '"""\n""""', '"""\n"" """"', "/*" + "* " * 500_000 + "*/z", '"""\n' + '"" ' * 300_000 + '"""z']
    lazy = lx.TOKEN_PATTERN.replace(lx._POSSESSIVE["COMMENT"], lx.RULES["COMMENT"]).replace(lx._POSSESSIVE["TEXT_BLOCK"], lx.RULES["TEXT_BLOCK"])
    assert lazy.count("*?") == 2
    cut = spark.createDataFrame([(t,) for t in texts], "t string").select(
        lx.lex(F.col("t")).alias("ours"), F.regexp_extract_all("t", F.lit(lazy), F.lit(0)).alias("theirs"))
    assert cut.count() == len(texts) and cut.where("ours <=> theirs").count() == len(texts)


def test_types_of_awkward_tokens(spark):
    text = 'x = 0x1F + 0b11 + 017 + 1_000L + 1.5e3f + 0x1.8p1 + 09.5; s = "a//b\\""; c = \'\\\'\'; t = """\n x """; don\'t >>>= a.b'
    rows = tk.tokens(spark.createDataFrame([(1, text)], "file_id bigint, content string")).orderBy("pos").collect()
    kinds = [(r.token_type, r.text) for r in rows if r.token_type.endswith(("LITERAL", "BLOCK", "ASSIGN"))]
    assert kinds == [("ASSIGN", "="), ("HEX_LITERAL", "0x1F"), ("BINARY_LITERAL", "0b11"), ("OCT_LITERAL", "017"),
                     ("DECIMAL_LITERAL", "1_000L"), ("FLOAT_LITERAL", "1.5e3f"), ("HEX_FLOAT_LITERAL", "0x1.8p1"),
                     ("FLOAT_LITERAL", "09.5"), ("ASSIGN", "="), ("STRING_LITERAL", '"a//b\\""'), ("ASSIGN", "="),
                     ("CHAR_LITERAL", "'\\''"), ("ASSIGN", "="), ("TEXT_BLOCK", '"""\n x """'), ("URSHIFT_ASSIGN", ">>>=")]


def test_declarations_and_balance(evaluate):
    for text, expected in [("class A {}", True), ("Foo.class x", False), ("@interface A {}", False), ("interface A {}", True),
                           ("record R() {}", False), ('"class A"', False), ("enum E {}", True), ("// class A\nint a;", False)]:
        assert evaluate(lx.declares_type, text) is expected, text
    for text, expected in [("({[]})", True), ("([)]", False), ("}", False), ("'{' \"(\" /* [ */", True), ("{", False)]:
        assert evaluate(lx.balanced, text) is expected, text
