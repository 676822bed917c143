"""Java tokens as column expressions: one regular expression cuts a text into tokens, a CASE types each.

Everything here works inside one row, so lexing never shuffles.  The pattern tries its alternatives left to
right; within each first-character group they are ordered so that the first match is the longest one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: the 128 token types, in type-number order ------------------------------------------------
KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum "
    "extends final finally float for if goto implements import instanceof int interface long native new "
    "package private protected public return short static strictfp super switch synchronized this throw "
    "throws transient try void volatile while "
    "module open requires exports opens to uses provides with transitive "
    "var yield record sealed permits non-sealed"
).split()
LITERAL_NAMES = (
    "DECIMAL_LITERAL HEX_LITERAL OCT_LITERAL BINARY_LITERAL FLOAT_LITERAL HEX_FLOAT_LITERAL BOOL_LITERAL "
    "CHAR_LITERAL STRING_LITERAL TEXT_BLOCK NULL_LITERAL"
).split()
SYMBOLS = dict(
    LPAREN="(", RPAREN=")", LBRACE="{", RBRACE="}", LBRACK="[", RBRACK="]", SEMI=";", COMMA=",", DOT=".",
    ASSIGN="=", GT=">", LT="<", BANG="!", TILDE="~", QUESTION="?", COLON=":", EQUAL="==", LE="<=", GE=">=",
    NOTEQUAL="!=", AND="&&", OR="||", INC="++", DEC="--", ADD="+", SUB="-", MUL="*", DIV="/", BITAND="&",
    BITOR="|", CARET="^", MOD="%", ADD_ASSIGN="+=", SUB_ASSIGN="-=", MUL_ASSIGN="*=", DIV_ASSIGN="/=",
    AND_ASSIGN="&=", OR_ASSIGN="|=", XOR_ASSIGN="^=", MOD_ASSIGN="%=", LSHIFT_ASSIGN="<<=",
    RSHIFT_ASSIGN=">>=", URSHIFT_ASSIGN=">>>=", ARROW="->", COLONCOLON="::", AT="@", ELLIPSIS="...",
)
HIDDEN_NAMES = ["WS", "COMMENT", "LINE_COMMENT"]
# Separators of the Java language specification; every other symbol is an operator.
SEPARATORS = "( ) { } [ ] ; , . ... @ ::".split()
# Words that are tokens of their own here but may also name things.
SOFT_KEYWORDS = KEYWORDS[KEYWORDS.index("module"):]
# -------------------------------------------------------------------------------------------------------------


def _token_types() -> list[tuple[int, str, str, str]]:
    """(type_no, token_type, category, literal) of every token type; literal is NULL for open classes."""
    rows = [(k.upper().replace("-", "_"), "KEYWORD", k) for k in KEYWORDS]
    rows += [(n, "LITERAL", "null" if n == "NULL_LITERAL" else None) for n in LITERAL_NAMES]
    rows += [(n, "SEPARATOR" if s in SEPARATORS else "OPERATOR", s) for n, s in SYMBOLS.items()]
    rows += [(n, "WHITESPACE" if n == "WS" else "COMMENT", None) for n in HIDDEN_NAMES]
    rows.append(("IDENTIFIER", "IDENTIFIER", None))
    return [(i + 1, *row) for i, row in enumerate(rows)]


TOKEN_TYPES = _token_types()
TYPE_NO = {name: no for no, name, _, _ in TOKEN_TYPES}
WORD_TYPES = {k: TYPE_NO[k.upper().replace("-", "_")] for k in KEYWORDS} | {
    "true": TYPE_NO["BOOL_LITERAL"], "false": TYPE_NO["BOOL_LITERAL"], "null": TYPE_NO["NULL_LITERAL"]}
SYMBOL_TYPES = {s: TYPE_NO[n] for n, s in SYMBOLS.items()}

# --- The pattern.  POSSESSIVE marks where the JVM form takes a possessive quantifier, which keeps matching
# iterative: the plain form recurses once per escape and overflows the stack on long literals.  Comments and text
# blocks have a JVM form of their own as well: a lazy quantifier tries what follows at each character of them.
_HEX = "[0-9a-fA-F]"
_HEX_DIGITS = f"{_HEX}(?:[0-9a-fA-F_]*{_HEX})?"
_DIGITS = "[0-9](?:[0-9_]*[0-9])?"
_SIMPLE = r"[btnfr\"'\\]|(?:[0-3]?[0-7])?[0-7]"
ESCAPE = rf"\\(?:(?:u005c)?(?:{_SIMPLE})|u+{_HEX}{{4}})"
_ESCAPE_NO_PREFIX = rf"\\(?:{_SIMPLE}|u+{_HEX}{{4}})"
_WORD = r"[A-Za-z$_\x{80}-\x{10FFFF}][0-9A-Za-z$_\x{80}-\x{10FFFF}]*"

RULES = {
    "WS": r"[ \t\r\n\f]+",
    "TEXT_BLOCK": r'"""[ \t]*[\r\n][\s\S]*?"""',
    "CHAR_LITERAL": rf"'(?:[^'\\\r\n]|{ESCAPE})'",
    "HEX_FLOAT_LITERAL": rf"0[xX](?:{_HEX_DIGITS}\.?|(?:{_HEX_DIGITS})?\.{_HEX_DIGITS})[pP][+-]?{_DIGITS}[fFdD]?",
    "HEX_LITERAL": rf"0[xX]{_HEX_DIGITS}[lL]?",
    "BINARY_LITERAL": r"0[bB][01](?:[01_]*[01])?[lL]?",
    "FLOAT_LITERAL": (rf"(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[fFdD]?"
                      rf"|{_DIGITS}(?:[eE][+-]?{_DIGITS}[fFdD]?|[fFdD])"),
    "OCT_LITERAL": r"0_*[0-7](?:[0-7_]*[0-7])?[lL]?",
    "DECIMAL_LITERAL": rf"(?:0|[1-9](?:_*{_DIGITS})?)[lL]?",
    "COMMENT": r"/\*[\s\S]*?\*/",
    "LINE_COMMENT": r"//[^\r\n]*",
    "IDENTIFIER": _WORD,
}
_POSSESSIVE = {
    "TEXT_BLOCK": r'"""[ \t]*[\r\n][^"]*+(?:"(?!"")[^"]*+)*+"""',
    "COMMENT": r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/",
}


def _string_body(escape: str, possessive: bool) -> str:
    star = "*+" if possessive else "*"
    plain = r'[^"\\\r\n]' + star
    return f'"{plain}(?:{escape}{plain}){star}'


def string_rule(possessive: bool) -> str:
    if not possessive:
        return _string_body(ESCAPE, False) + '"'
    return f'{_string_body(ESCAPE, True)}"|{_string_body(_ESCAPE_NO_PREFIX, True)}"'


def token_pattern(possessive: bool = True) -> str:
    """One alternation for all tokens.  ``possessive=False`` is the same pattern for engines without it."""
    rules = {**RULES, **_POSSESSIVE} if possessive else RULES
    quotes_failed = [
        rf"'(?:[^'\\\r\n]|{ESCAPE}|\\)?[\s\S]?",
        _string_body(ESCAPE, possessive) + r"\\?[\s\S]?",
    ]
    symbols = sorted(SYMBOLS.values(), key=len, reverse=True)
    escaped = ["".join("\\" + c if c in r".^$*+?{}[]()|/&-" else c for c in s) for s in symbols]
    numbers = "HEX_FLOAT_LITERAL HEX_LITERAL BINARY_LITERAL FLOAT_LITERAL OCT_LITERAL DECIMAL_LITERAL".split()
    parts = [rules["WS"], "non-sealed", rules["IDENTIFIER"], *(rules[n] for n in numbers),
             rules["COMMENT"], rules["LINE_COMMENT"], rules["TEXT_BLOCK"], string_rule(possessive),
             rules["CHAR_LITERAL"], *escaped, *quotes_failed, r"[\s\S]"]
    return "|".join(parts)


TOKEN_PATTERN = token_pattern()


def lex(content: Column) -> Column:
    """array<string>: every piece of the text in order, errors included; concatenated they give the text."""
    return F.regexp_extract_all(content, F.lit(TOKEN_PATTERN), F.lit(0))


def lex_after_blanks(content: Column, line_ends: bool = True) -> Column:
    """The same without the blanks before a token, which may leave an empty piece at the end: half as many pieces of most texts.
    Without ``line_ends`` no whitespace stays."""
    blanks = r"[ \t\r\f]" if line_ends else r"[ \t\r\n\f]"
    return F.regexp_extract_all(content, F.lit(rf"{blanks}*+({TOKEN_PATTERN}|\z)"), F.lit(1))


def _lookup(table: dict[str, object], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def is_space(token: Column) -> Column:
    return F.ascii(token).isin(32, 9, 10, 12, 13)


def is_comment(token: Column) -> Column:
    return token.startswith("/*") | token.startswith("//")


def _starts_word(code: Column) -> Column:
    return (code.between(97, 122) | code.between(65, 90) | (code >= 128) | code.isin(36, 95))


def by_class(token: Column, *, space, word, number, quoted, comment, symbol) -> Column:
    """One branch per first-character class, most frequent first; each argument is the branch's result."""
    code = F.ascii(token)
    return (F.when(is_space(token), space)
            .when(_starts_word(code), word)
            .when(code.between(48, 57) | ((code == 46) & (F.length(token) > 1) & (token != "...")), number)
            .when(code.isin(34, 39), quoted)
            .when(is_comment(token), comment)
            .otherwise(symbol))


def number_type(token: Column) -> Column:
    no = lambda name: F.lit(TYPE_NO[name])
    return (F.when(token.rlike(r"^0[xX]"),
                   F.when(token.rlike("[pP]"), no("HEX_FLOAT_LITERAL")).otherwise(no("HEX_LITERAL")))
            .when(token.rlike(r"^0[bB]"), no("BINARY_LITERAL"))
            .when(token.rlike(r"[.eEfFdD]"), no("FLOAT_LITERAL"))
            .when(token.rlike(r"^0_*[0-7]"), no("OCT_LITERAL"))
            .otherwise(no("DECIMAL_LITERAL")))


def quoted_type(token: Column) -> Column:
    """Type of a token that starts with a quote; 0 for one the lexer gives up on."""
    return (F.when(token.startswith('"""'), F.lit(TYPE_NO["TEXT_BLOCK"]))
            .when(token.rlike(rf"\A(?:{string_rule(True)})\z"), F.lit(TYPE_NO["STRING_LITERAL"]))
            .when(token.rlike(rf"\A(?:{RULES['CHAR_LITERAL']})\z"), F.lit(TYPE_NO["CHAR_LITERAL"]))
            .otherwise(F.lit(0)))


def comment_type(token: Column) -> Column:
    return F.when(token.startswith("/*"), F.lit(TYPE_NO["COMMENT"])).otherwise(F.lit(TYPE_NO["LINE_COMMENT"]))


def type_no(token: Column) -> Column:
    """Type number 1..128 of a token text, 0 for an error."""
    word = F.when(token.isin(*WORD_TYPES), _lookup(WORD_TYPES, token)).otherwise(F.lit(TYPE_NO["IDENTIFIER"]))
    return by_class(token, space=F.lit(TYPE_NO["WS"]), word=word, number=number_type(token),
                    quoted=quoted_type(token), comment=comment_type(token),
                    symbol=F.coalesce(_lookup(SYMBOL_TYPES, token), F.lit(0)))


def category(token: Column) -> Column:
    """Category of a token text without its exact type: set lookups only.  NULL for an error."""
    literal_words = ["true", "false", "null"]
    word = (F.when(token.isin(*KEYWORDS), "KEYWORD").when(token.isin(*literal_words), "LITERAL")
            .otherwise("IDENTIFIER"))
    symbol = (F.when(token.isin(*SEPARATORS), "SEPARATOR")
              .when(token.isin(*(s for s in SYMBOL_TYPES if s not in SEPARATORS)), "OPERATOR"))
    return by_class(token, space=F.lit("WHITESPACE"), word=word, number=F.lit("LITERAL"),
                    quoted=F.when(quoted_type(token) > 0, "LITERAL"), comment=F.lit("COMMENT"), symbol=symbol)


def is_identifier(token: Column) -> Column:
    return _starts_word(F.ascii(token)) & ~token.isin(*WORD_TYPES)


def is_string(token: Column) -> Column:
    return token.startswith('"') & ~token.startswith('"""') & (quoted_type(token) > 0)


# --- Shapes: one character per significant token, so questions about neighbours become regular expressions ---
SHAPE_BASE = 0xE000 + 97


def shape_char(name: str) -> str:
    return chr(SHAPE_BASE + TYPE_NO[name])


def shape_of(token: Column) -> Column:
    """The character of a token; empty for whitespace, comments and errors."""
    chars = lambda table: {k: chr(SHAPE_BASE + v) for k, v in table.items()}
    numbered = F.array(*(F.lit(chr(SHAPE_BASE + i)) for i in range(129)))
    word = (F.when(token.isin(*WORD_TYPES), _lookup(chars(WORD_TYPES), token))
            .otherwise(F.lit(shape_char("IDENTIFIER"))))
    quoted = quoted_type(token)
    return by_class(
        token, space=F.lit(""), word=word, number=F.element_at(numbered, number_type(token) + 1),
        quoted=F.when(quoted > 0, F.element_at(numbered, quoted + 1)).otherwise(F.lit("")),
        comment=F.lit(""), symbol=F.coalesce(_lookup(chars(SYMBOL_TYPES), token), F.lit("")))


def shape(content: Column) -> Column:
    """String with one character per token that is neither whitespace nor comment nor error."""
    return F.array_join(F.transform(lex_after_blanks(content, line_ends=False), shape_of), "")


def significant(content: Column) -> Column:
    """array<struct<text, c>>: the pieces that are neither whitespace nor comment nor error, each with its character."""
    shaped = F.transform(lex_after_blanks(content, line_ends=False), lambda t: F.struct(t.alias("text"), shape_of(t).alias("c")))
    return F.filter(shaped, lambda x: x["c"] != "")


NAME_SHAPES = "".join([shape_char("IDENTIFIER"), *(shape_char(k.upper().replace("-", "_")) for k in SOFT_KEYWORDS)])
DECLARATION_SHAPE = (
    f"(?:^|[^{shape_char('DOT')}])[{shape_char('CLASS')}{shape_char('ENUM')}][{NAME_SHAPES}]"
    f"|(?:^|[^{shape_char('DOT')}{shape_char('AT')}]){shape_char('INTERFACE')}[{NAME_SHAPES}]")


BRACKETS = {shape_char(a): shape_char(b) for a, b in (("LPAREN", "RPAREN"), ("LBRACK", "RBRACK"), ("LBRACE", "RBRACE"))}


def _balanced_shape(shaped: Column) -> Column:
    found = F.regexp_extract_all(shaped, F.lit(f"[{''.join([*BRACKETS, *BRACKETS.values()])}]"), F.lit(0))

    def closer(t: Column) -> Column:
        branches = F
        for opening, closing in BRACKETS.items():
            branches = branches.when(t == opening, closing)
        return branches

    def step(stack: Column, token: Column) -> Column:
        # The stack holds the closers still expected; "!" marks a mismatch and never leaves the bottom.
        closed = F.when(F.endswith(stack, token), F.left(stack, F.length(stack) - 1)).otherwise(F.lit("!"))
        return (F.when(stack.startswith("!"), F.lit("!")).when(closer(token).isNotNull(), F.concat(stack, closer(token)))
                .otherwise(closed))

    return F.aggregate(found, F.lit(""), step) == ""


def judge(content: Column, rule) -> Column:
    """``rule(declares, balanced)`` of a text, lexed once: whether it declares a class, an interface or an enum
    anywhere, and whether every bracket outside literals and comments closes the one opened last."""
    return judge_shape(shape(content), rule)


def judge_shape(shaped: Column, rule) -> Column:
    """The same of the shape of a text."""
    verdict = F.transform(F.array(shaped), lambda s: rule(s.rlike(DECLARATION_SHAPE), _balanced_shape(s)))
    return F.element_at(verdict, 1)


def declares_type(content: Column) -> Column:
    return judge(content, lambda declares, _: declares)


def balanced(content: Column) -> Column:
    return judge(content, lambda _, closes: closes)
