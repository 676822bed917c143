"""DuckDB statements with the same results as the queries of ``catalog``.

The fixed tables and the token pattern come from the same definitions; the logic is written for SQL on its own.
"""

from __future__ import annotations

from tokenloom.functions import codec as cd
from tokenloom.functions import lexing as lx
from tokenloom.functions import text as tx
from tokenloom.operators import bpe, lattice
from tokenloom.plans.settings import (BATCH, EXTRA_IDS, MAX_LENGTH, MERGES, REPORT_EVERY, SAMPLE_MERGES, SAMPLE_PERCENT, SHARD_ROWS,
                                      SWEEP, TOP, TRAIN_RATIO)
from tokenloom.sources import tables as tb


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    def one(v):
        return "NULL" if v is None else text(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


def chars(codes) -> str:
    return " || ".join(f"chr({c})" for c in codes)


PATTERN = text(lx.token_pattern(possessive=False))
_SPACES = [ord(c) for c in tx.UNICODE_SPACE]
_STRIP = f"({chars(_SPACES)})"
_TRIM = r"'^[\x00-\x20]+|[\x00-\x20]+$'"


def path_of(doc: str = "doc_id", src: str = "source", body: str = "text") -> str:
    return (f"CASE {doc} % 7 WHEN 0 THEN 'Doc' || {doc} || '.java' WHEN 1 THEN 'repo/' || {src} || '/Doc-' || {doc} || '.java' "
            f"WHEN 2 THEN 'repo/' || {src} || '/' || md5({body}) || '.java' WHEN 3 THEN 'repo/' || {src} || '/Doc' || {doc} || '.txt' "
            f"ELSE 'repo/' || {src} || '/Doc' || {doc} || '.java' END")


FILES = f"files AS (SELECT doc_id AS file_id, source AS shard, {path_of()} AS path, text AS content FROM documents)"
BLANKED = FILES.replace("text AS content", "CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) || chr(9) ELSE text END AS content")
PAGES = ("files AS (SELECT page_id AS file_id, 'site' || (page_id % 10) AS shard, url AS path, html AS content FROM pages)")


def _java() -> str:
    cases = " ".join(f"WHEN {k} THEN {text(v)}" for k, v in tb.declaration_cases().items())
    parts = " || ".join(text(p) if isinstance(p, str) else f"CAST({p[0]} AS VARCHAR)" for p in tb.java_pieces())
    return f"""made AS (SELECT *, CASE doc_id % 10 {cases} ELSE 'public class Doc' END AS declaration,
        replace(replace(text, chr(13), ' '), chr(10), ' ') AS flat,
        replace(replace(replace(replace(text, chr(13), ' '), chr(10), ' '), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') AS quoted,
        format('{{:o}}', doc_id) AS octal_id, format('{{:b}}', doc_id) AS binary_id,
        CASE WHEN doc_id % 10 = 8 THEN '' ELSE '}}' || chr(10) END AS tail FROM documents),
      java_text AS (SELECT doc_id, source, {parts} AS text FROM made),
      files AS (SELECT doc_id AS file_id, source AS shard, {path_of()} AS path, text AS content FROM java_text)"""


JAVA = _java()

TYPES = "types AS " + values(lx.TOKEN_TYPES, "type_no, token_type, category, literal")
WORDS = ("words AS (SELECT literal AS word, type_no FROM types WHERE literal IS NOT NULL "
         "UNION ALL SELECT unnest(['true', 'false']), (SELECT type_no FROM types WHERE token_type = 'BOOL_LITERAL'))")


def _open_types() -> str:
    order = ("IDENTIFIER WS COMMENT LINE_COMMENT HEX_FLOAT_LITERAL HEX_LITERAL BINARY_LITERAL FLOAT_LITERAL OCT_LITERAL "
             "DECIMAL_LITERAL TEXT_BLOCK CHAR_LITERAL").split()
    cases = [f"WHEN regexp_full_match(text, {text(lx.RULES[n])}) THEN {lx.TYPE_NO[n]}" for n in order]
    cases.append(f"WHEN regexp_full_match(text, {text(lx.string_rule(False))}) THEN {lx.TYPE_NO['STRING_LITERAL']}")
    return "CASE " + " ".join(cases) + " ELSE 0 END"


def lexed(source: str) -> str:
    """CTEs up to ``tokens(file_id, pos, text, type_no, token_type, category)`` from ``files``; errors left out."""
    return f"""WITH {source}, {TYPES}, {WORDS},
      cut AS (SELECT file_id, regexp_extract_all(content, {PATTERN}) AS a FROM files),
      pieces AS (SELECT file_id, unnest(range(len(a))) AS pos, unnest(a) AS text FROM cut),
      distinct_texts AS (SELECT DISTINCT text FROM pieces),
      known AS (SELECT d.text, coalesce(w.type_no, {_open_types()}) AS type_no
                FROM distinct_texts d LEFT JOIN words w ON d.text = w.word),
      tokens AS (SELECT p.file_id, p.pos, p.text, t.type_no, t.token_type, t.category
                 FROM pieces p JOIN known k ON p.text = k.text JOIN types t ON k.type_no = t.type_no)"""


# --- Encoding -----------------------------------------------------------------------------------------------------
_PRINTABLE, _LETTERS = text(cd.PRINTABLE), text("".join(cd.id_char(cd.ID_OF[c]) for c in cd.PRINTABLE))
SPELL = (rf"translate(regexp_replace(regexp_replace(text, '[\x{{10000}}-\x{{10FFFF}}]', '__', 'g'), '[^ -~]', '_', 'g'), "
         f"{_PRINTABLE}, {_LETTERS})")
ENCODED = f"""CASE WHEN token_type = 'WS' THEN repeat(chr({cd.PUA_START}) || chr(10), length(text) - length(replace(text, chr(10), '')))
        WHEN category = 'COMMENT' THEN '' WHEN text = 'true' THEN chr({cd.PUA_START + cd.TRUE_ID}) WHEN text = 'false' THEN chr({cd.PUA_START + cd.FALSE_ID})
        WHEN token_type = 'IDENTIFIER' AND regexp_full_match(text, '[ -~]') THEN {SPELL}
        WHEN token_type = 'IDENTIFIER' THEN chr({cd.PUA_START + cd.IDENTIFIER_ID}) || {SPELL}
        ELSE chr({cd.PUA_START + cd.FIRST_TYPE_ID - 1} + type_no) END"""

_COMPACT = (f"list_filter(list_transform(regexp_split_to_array(content, '\\r\\n|[\\n\\r]'), "
            f"lambda x: trim(x, ({chars(ord(c) for c in tx.BREAKING_SPACE)}))), lambda x: x <> '')")


def compacted(source: str) -> str:
    """Rename ``files`` and put the stripped non-empty lines in its place."""
    return (source.replace("files AS (", "raw AS (", 1) if source.startswith("files") else source.replace(" files AS (", " raw AS (", 1)) + (
        f", files AS (SELECT file_id, shard, path, array_to_string(l, chr(10)) || chr(10) AS content "
        f"FROM (SELECT *, {_COMPACT} AS l FROM raw) WHERE len(l) > 0)")


def encoded(source: str) -> str:
    """CTEs up to ``encoded(file_id, shard, path, unicode)``, files without tokens left out."""
    return lexed(compacted(source)) + f""",
      pieces_encoded AS (SELECT file_id, pos, {ENCODED} AS piece FROM tokens),
      by_file AS (SELECT file_id, string_agg(piece, '' ORDER BY pos) AS unicode FROM pieces_encoded GROUP BY file_id),
      encoded AS (SELECT e.file_id, f.shard, f.path, e.unicode FROM by_file e JOIN files f USING (file_id) WHERE e.unicode <> '')"""


def encoded_lines(source: str) -> str:
    return encoded(source) + """,
      split_lines AS (SELECT file_id, shard, unnest(range(len(l))) AS line_no, unnest(l) AS unicode
                      FROM (SELECT file_id, shard, string_split(unicode, chr(10)) AS l FROM encoded)),
      lines AS (SELECT * FROM split_lines WHERE unicode <> '')"""


def ids_text(column: str) -> str:
    return (f"array_to_string(list_transform(list_filter(string_split({column}, ''), lambda c: c <> '' AND unicode(c) BETWEEN "
            f"{cd.PUA_START} AND {cd.PUA_START + cd.BASE_SIZE - 1}), lambda c: unicode(c) - {cd.PUA_START}), ' ')")


# --- Decoding: the in-name flag of every position is whether the last longer key before it was the marker ----------
def decoded(rows: str) -> str:
    """CTEs up to ``decoded(file_id, code)`` from a query of (file_id, pos, id); an unknown id is NULL."""
    ph = {cd.ID_OF[f"!LEX_{n}_LITERAL"]: "0" for n in "DECIMAL HEX OCT BINARY FLOAT HEX_FLOAT".split()}
    ph |= {cd.ID_OF["!LEX_CHAR_LITERAL"]: "'x'", cd.ID_OF["!LEX_STRING_LITERAL"]: '""', cd.ID_OF["!LEX_TEXT_BLOCK"]: '""'}
    vocab = values([(i, len(k), ph.get(i, v)) for i, k, v in cd.BASE_VOCABULARY], "id, key_length, shown")
    mark, eol = cd.IDENTIFIER_ID, cd.EOL_ID
    return f"""ids AS ({rows}), vocab AS {vocab},
      joined AS (SELECT i.file_id, i.pos, i.id, v.key_length, v.shown,
                 last_value(CASE WHEN v.key_length IS NULL OR v.key_length > 1 THEN coalesce(i.id, -1) = {mark} END IGNORE NULLS)
                   OVER (PARTITION BY i.file_id ORDER BY i.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS in_name
                 FROM ids i LEFT JOIN vocab v ON i.id = v.id),
      spoken AS (SELECT file_id, pos, CASE WHEN key_length IS NULL THEN '<?>' WHEN id = {eol} THEN chr(10)
                   WHEN id = {mark} THEN CASE WHEN in_name THEN ' ' ELSE '' END
                   WHEN in_name AND key_length = 1 THEN shown
                   ELSE CASE WHEN in_name THEN ' ' ELSE '' END || shown || ' ' END AS piece FROM joined),
      decoded AS (SELECT file_id, regexp_replace(string_agg(piece, '' ORDER BY pos), {_TRIM}, '', 'g') AS code FROM spoken GROUP BY file_id)"""


def char_rows(source: str, column: str) -> str:
    return (f"SELECT file_id, unnest(range(len(c))) AS pos, CASE WHEN unicode(unnest(c)) BETWEEN {cd.PUA_START} AND {cd.PUA_START + cd.BASE_SIZE - 1} "
            f"THEN unicode(unnest(c)) - {cd.PUA_START} END AS id FROM (SELECT file_id, string_split(replace({column}, chr(10), ''), '') AS c FROM {source})")


# --- Cleaning -----------------------------------------------------------------------------------------------------
NORMAL = r"regexp_replace(content, '\r\n?', chr(10), 'g')"
_HEADER = (r"(?:\A|\n)([\x{00}-\x{09}\x{0B}-\x{20}]*(?:" + "|".join(tx.HEADER_START)
           + r")[^\n\x{85}\x{2028}\x{2029}]*(?:\n[\s\S]*)?)\z")
HEADLESS = rf"regexp_replace(regexp_extract({NORMAL}, {text(_HEADER)}, 1), '\n+\z', '')"


def headless(source: str) -> str:
    new = source.replace("files AS (", "raw AS (", 1) if source.startswith("files") else source.replace(" files AS (", " raw AS (", 1)
    return new + f", files AS (SELECT file_id, shard, path, {HEADLESS} AS content FROM raw)"


_NAMES = ", ".join([str(lx.TYPE_NO["IDENTIFIER"]), *(str(lx.WORD_TYPES[k]) for k in lx.SOFT_KEYWORDS if k != "non-sealed")])
_NO = lx.TYPE_NO
SIGNIFICANT = "sig AS (SELECT file_id, pos, type_no, text FROM tokens WHERE category NOT IN ('WHITESPACE', 'COMMENT'))"
DEPTH = ("sum(CASE text WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING)")
PLAIN = SIGNIFICANT + f", kept AS (SELECT *, {DEPTH} AS depth FROM sig)"
UNANNOTATED = SIGNIFICANT + f""",
      near AS (SELECT *, lag(type_no) OVER o AS p, lead(type_no) OVER o AS f, {DEPTH} AS depth FROM sig WINDOW o AS (PARTITION BY file_id ORDER BY pos)),
      run AS (SELECT *, coalesce((type_no IN ({_NAMES}) AND p IN ({_NO['AT']}, {_NO['DOT']}))
                 OR (type_no = {_NO['DOT']} AND p IN ({_NAMES}) AND f IN ({_NAMES})), false) AS in_run,
               coalesce(type_no = {_NO['AT']} AND f IN ({_NAMES}), false) AS starts FROM near),
      grouped AS (SELECT *, sum(CASE WHEN in_run THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM run),
      headed AS (SELECT *, bool_or(starts) OVER (PARTITION BY file_id, g) AS mine FROM grouped),
      heads AS (SELECT file_id, g, min(pos) AS first_pos, max(pos) AS last_pos FROM headed WHERE mine GROUP BY file_id, g),
      opened AS (SELECT h.file_id, h.first_pos, h.last_pos, n.pos AS open_pos, n.depth AS level
                 FROM heads h LEFT JOIN headed n ON n.file_id = h.file_id AND n.g = h.g + 1 AND n.text = '(' AND NOT n.in_run),
      closes AS (SELECT file_id, pos, depth FROM near WHERE text = ')'),
      spans AS (SELECT o.file_id, o.first_pos, coalesce(c.pos, o.last_pos) AS last_pos
                FROM opened o ASOF LEFT JOIN (SELECT file_id, pos, depth + 1 AS level FROM closes) c
                ON o.file_id = c.file_id AND o.level = c.level AND o.open_pos < c.pos),
      marks AS (SELECT file_id, first_pos AS pos, max(last_pos) AS reach FROM spans GROUP BY ALL),
      covered AS (SELECT n.*, max(m.reach) OVER (PARTITION BY n.file_id ORDER BY n.pos ROWS UNBOUNDED PRECEDING) AS reach
                  FROM near n LEFT JOIN marks m ON n.file_id = m.file_id AND n.pos = m.pos),
      kept AS (SELECT * FROM covered WHERE reach IS NULL OR reach < pos)"""
LAYOUT = (r"regexp_replace(string_agg(text || CASE WHEN text IN (';', '{', '}') AND depth <= 0 THEN chr(10) ELSE ' ' END, '' ORDER BY pos), '[ \n]\z', '')")

# A token list per file answers bracket and declaration questions.
CLOSER = "CASE {0} WHEN '(' THEN ')' WHEN '[' THEN ']' WHEN '{{' THEN '}}' END"
BALANCED = f"""brackets AS (SELECT file_id, list(text ORDER BY pos) FILTER (text IN ('(', ')', '[', ']', '{{', '}}')) AS b FROM tokens GROUP BY file_id),
      checked AS (SELECT f.file_id, coalesce(list_reduce(b, lambda s, x: CASE WHEN starts_with(s, '!') THEN '!'
                   WHEN {CLOSER.format('x')} IS NOT NULL THEN s || {CLOSER.format('x')}
                   WHEN right(s, 1) = x THEN left(s, length(s) - 1) ELSE '!' END, ''), '') = '' AS balanced
                  FROM files f LEFT JOIN brackets USING (file_id))"""
DECLARED = f"""around AS (SELECT file_id, type_no, lag(type_no) OVER o AS p, lead(type_no) OVER o AS f FROM sig WINDOW o AS (PARTITION BY file_id ORDER BY pos)),
      declared AS (SELECT DISTINCT file_id FROM around WHERE f IN ({_NAMES}, {_NO['NON_SEALED']}) AND
        ((type_no IN ({_NO['CLASS']}, {_NO['ENUM']}) AND coalesce(p, 0) <> {_NO['DOT']})
         OR (type_no = {_NO['INTERFACE']} AND coalesce(p, 0) NOT IN ({_NO['DOT']}, {_NO['AT']}))))"""
FILE_NAME = (r"coalesce(nullif(regexp_extract(path, '/(\w+)\.java\n?\z', 1), ''), 'JavaFile_' || file_id) || '_' || file_id || '.java'")
HASH_NAME = rf"regexp_full_match({FILE_NAME}, '[0-9a-fA-F]{{32}}_[0-9]+\.java')"
JUDGED = f"{lexed(headless(JAVA))}, {SIGNIFICANT}, {BALANCED}, {DECLARED}, judged AS (SELECT f.file_id, f.shard, {HASH_NAME} AS hashed, c.balanced, d.file_id IS NOT NULL AS has_type FROM files f JOIN checked c USING (file_id) LEFT JOIN declared d USING (file_id))"

# --- Statistics ----------------------------------------------------------------------------------------------------
_UNITS = r"(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))"
_ENDS = r"len(regexp_extract_all(text, '\r\n|\r|\n'))"
_BLANKS = r"length(regexp_replace(text, '[\r\n]', '', 'g'))"
_STATS = f"""count(*) FILTER (category <> 'WHITESPACE') + sum(CASE WHEN category = 'WHITESPACE' THEN {_ENDS} + {_BLANKS} ELSE 0 END) AS total_tokens,
      sum(CASE WHEN category = 'WHITESPACE' THEN {_ENDS} ELSE 0 END) AS eol, sum(CASE WHEN category = 'WHITESPACE' THEN {_BLANKS} ELSE 0 END) AS whitespace_no_eol,
      count(*) FILTER (category = 'COMMENT') AS comment, count(*) FILTER (category = 'IDENTIFIER') AS identifier, count(*) FILTER (category = 'KEYWORD') AS keyword,
      count(*) FILTER (category = 'LITERAL') AS literal, count(*) FILTER (category = 'SEPARATOR') AS separator, count(*) FILTER (category = 'OPERATOR') AS operator,
      count(*) FILTER (token_type = 'STRING_LITERAL') AS string_literals, coalesce(sum({_UNITS}) FILTER (token_type = 'STRING_LITERAL'), 0) AS literal_chars,
      coalesce(sum(strlen(text)) FILTER (token_type = 'STRING_LITERAL'), 0) AS literal_bytes, coalesce(sum({_UNITS}) FILTER (category = 'IDENTIFIER'), 0) AS identifier_chars,
      coalesce(sum(strlen(text)) FILTER (category = 'IDENTIFIER'), 0) AS identifier_bytes, sum(strlen(text)) AS total_bytes,
      coalesce(max({_UNITS}) FILTER (token_type = 'STRING_LITERAL'), 0) AS max_literal_chars, coalesce(max({_UNITS}) FILTER (category = 'IDENTIFIER'), 0) AS max_identifier_chars"""
_COLUMNS = "total_tokens eol whitespace_no_eol comment identifier keyword literal separator operator string_literals literal_chars literal_bytes identifier_chars identifier_bytes total_bytes max_literal_chars max_identifier_chars".split()
_AS_BIGINT = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _COLUMNS)
_TYPED_BLANKS = """spread AS (SELECT 'EOL' AS category, sum(%s) AS n FROM tokens WHERE category = 'WHITESPACE' UNION ALL
      SELECT 'WHITESPACE_NO_EOL', sum(%s) FROM tokens WHERE category = 'WHITESPACE' UNION ALL
      SELECT category, count(*) FROM tokens WHERE category <> 'WHITESPACE' GROUP BY category)""" % (_ENDS, _BLANKS)
FREQ = """freq AS (SELECT kind, replace(text, chr(13), '') AS item, count(*) AS cnt FROM
      (SELECT text, CASE WHEN category = 'IDENTIFIER' THEN 'identifiers' WHEN token_type = 'STRING_LITERAL' THEN 'literals' END AS kind FROM tokens)
      WHERE kind IS NOT NULL GROUP BY ALL)"""

# --- Shards --------------------------------------------------------------------------------------------------------
RANKS = ("ranks AS (SELECT shard, row_number() OVER (ORDER BY shard) AS rn, count(*) OVER () AS k FROM (SELECT DISTINCT shard FROM files))")


# --- Byte pairs: a recursion over the merges, each counting all pairs of all words again ------------------------------
def pairs_of(words: str, name: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT pair, sum(n) AS c FROM (SELECT unnest(list_transform(range(1, len(a)), lambda k: a[k] || a[k + 1])) AS pair, n "
            f"FROM (SELECT string_split(word, '') AS a, n FROM {words})) GROUP BY pair)")


def code_id(char: str) -> str:
    return (f"CASE WHEN unicode({char}) >= {bpe.SYMBOL_START} THEN unicode({char}) - {bpe.SYMBOL_START} "
            f"WHEN unicode({char}) BETWEEN {cd.PUA_START} AND {cd.PUA_START + cd.BASE_SIZE - 1} THEN unicode({char}) - {cd.PUA_START - len(bpe.SPECIAL_TOKENS)} ELSE {bpe.UNKNOWN_ID} END")


def _words(kept: str = "lines") -> str:
    return encoded_lines(FILES) + f""",
      w0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY unicode) - 1 AS key, unicode AS word, count(*) AS n FROM {kept} GROUP BY unicode)"""


def _bpe(merges: int = MERGES, kept: str = "lines") -> str:
    """CTEs up to ``merged(rank, pair, sym, total_before)`` and ``final(original, word, n)``.

    The state of the recursion is one row per word and one per merge (with a negative key).  A merge whose text is that
    of an earlier one gets its symbol.
    """
    first = bpe.SYMBOL_START + len(bpe.SPECIAL_TOKENS) + cd.BASE_SIZE
    spelled = lambda side: f"coalesce((SELECT min(text) FROM recs WHERE sym = {side}(pair, 1)), {side}(pair, 1))"
    return _words(kept).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
      t(key, word, n, sym, text) USING KEY (key) AS MATERIALIZED (
        SELECT key, word, CAST(n AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM w0
        UNION
        (WITH words AS (SELECT key, word, n FROM recurring.t WHERE key >= 0),
           recs AS (SELECT sym, text FROM recurring.t WHERE key < 0),
           done AS (SELECT count(*) AS i, count(DISTINCT sym) AS k FROM recs),
           {pairs_of("words", "pairs")},
           best AS (SELECT pair FROM pairs WHERE c >= {bpe.MIN_FREQUENCY} ORDER BY c DESC, pair LIMIT 1),
           named AS (SELECT pair, {spelled("left")} || {spelled("right")} AS text FROM best),
           chosen AS (SELECT pair, text, i, coalesce((SELECT min(sym) FROM recs WHERE recs.text = named.text), chr(CAST({first} + k AS INT))) AS sym
                      FROM named, done WHERE k < {merges})
         SELECT w.key, replace(w.word, c.pair, c.sym), w.n, NULL, NULL FROM words w, chosen c WHERE contains(w.word, c.pair)
         UNION ALL SELECT -1 - i, pair, (SELECT CAST(sum(n * length(word)) AS BIGINT) FROM words), sym, text FROM chosen)),
      merged AS (SELECT -1 - key AS rank, word AS pair, sym, text, n AS total_before FROM t WHERE key < 0),
      final AS (SELECT w0.word AS original, t.word, t.n FROM t JOIN w0 USING (key))"""


def _sizes() -> str:
    return " UNION ALL ".join(
        f"SELECT {s} AS vocab_size, coalesce((SELECT total_before FROM merged WHERE sym = chr({bpe.SYMBOL_START + s}) ORDER BY rank LIMIT 1), "
        f"(SELECT CAST(sum(n * length(word)) AS BIGINT) FROM final)) AS total_tokens" for s in SWEEP)


def _cheapest(name: str, costs: str) -> str:
    """Best paths to all places of the distinct words: least cost, fewer pieces, longest last piece."""
    return f"""
      {name}(id, word, pos, cost, pieces, start) USING KEY (id, pos) AS (
        SELECT id, word, 0, CAST(0 AS BIGINT), 0, 0 FROM baseline_words
        UNION
        SELECT id, word, pos, b.cost, b.pieces, b.start FROM (
          SELECT w.id, w.word, w.pos + 1 AS pos, min({{'cost': r.cost + c.cost, 'pieces': r.pieces + 1, 'start': r.pos}}) AS b
          FROM {name} w JOIN recurring.{name} r ON r.id = w.id AND r.pos > w.pos - {lattice.LONGEST} AND r.pos <= w.pos
          JOIN {costs} c ON c.piece = substr(w.word, r.pos + 1, w.pos + 1 - r.pos) WHERE w.pos < length(w.word) GROUP BY ALL))"""


def _costs(name: str, counts: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT piece, CAST(floor({lattice.UNIT} * log2(CAST(sum(c) OVER () AS DOUBLE) / c) + 0.5) AS BIGINT) AS cost FROM {counts})"


def _baseline(size: int) -> str:
    """CTEs up to ``baseline(vocab_size, total_tokens)``: pieces by the text that they cover, a pass, and the count after it."""
    return rf"""
      baseline_words AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT word, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(text, '\S+')) AS word FROM documents) GROUP BY word)),
      substrings AS MATERIALIZED (SELECT substr(word, i, l) AS piece, sum(n) AS c FROM (
        SELECT word, n, i, unnest(range(1, least({lattice.LONGEST}, length(word) - i + 1) + 1)) AS l FROM (
          SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM baseline_words)) GROUP BY 1),
      seeds AS (SELECT piece, c FROM substrings WHERE length(piece) = 1 UNION ALL SELECT piece, c FROM (
        SELECT piece, c, row_number() OVER (ORDER BY c * length(piece) DESC, piece) AS k FROM substrings WHERE length(piece) > 1)
        WHERE k <= {size} - (SELECT count(*) FROM substrings WHERE length(piece) = 1)),
      {_costs("seed_costs", "seeds")}, {_cheapest("seed_paths", "seed_costs")},
      walked(id, word, pos) AS (
        SELECT id, word, length(word) FROM baseline_words UNION ALL
        SELECT w.id, w.word, p.start FROM walked w JOIN seed_paths p ON p.id = w.id AND p.pos = w.pos WHERE p.start > 0),
      used AS (SELECT substr(w.word, p.start + 1, w.pos - p.start) AS piece, sum(b.n) AS c FROM walked w
        JOIN seed_paths p ON p.id = w.id AND p.pos = w.pos JOIN baseline_words b ON b.id = w.id GROUP BY 1),
      kept AS (SELECT piece, greatest(sum(c), 1) AS c FROM (
        SELECT * FROM used UNION ALL SELECT piece, 0 FROM substrings WHERE length(piece) = 1) GROUP BY piece),
      {_costs("unigram_costs", "kept")}, {_cheapest("unigram_paths", "unigram_costs")},
      baseline AS MATERIALIZED (SELECT {size} AS vocab_size, CAST(sum(n * pieces) AS BIGINT) AS total_tokens FROM unigram_paths p
        JOIN baseline_words b ON b.id = p.id AND p.pos = length(b.word))"""


def statements() -> dict[str, str]:
    java, pages = lexed(JAVA), lexed(PAGES)
    files = f"WITH {FILES}"
    sharded = f"WITH {FILES}, {RANKS}"
    enc = encoded(FILES)
    clean = f"{lexed(headless(JAVA))}, {UNANNOTATED}"
    size = len(bpe.SPECIAL_TOKENS) + cd.BASE_SIZE
    vocab = "vocab AS " + values(cd.BASE_VOCABULARY, "token_id, key, value")
    draw = lambda label, bound: (f"CASE WHEN {bound} > 0 THEN CAST('0x' || substr(md5(file_id || ':0:{label}'), 1, 8) AS BIGINT) % ({bound}) ELSE 0 END")
    part = lambda a, b: f"array_to_string(l[CAST({a} + 1 AS BIGINT):CAST({b} AS BIGINT)], chr(10))"
    any_break = text(tx.ANY_LINE_BREAK)
    lines = (f"lines AS (SELECT file_id, shard, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT file_id, shard, "
             f"list_filter(list_transform(regexp_split_to_array(content, {any_break}), lambda x: trim(x, {_STRIP})), lambda x: x <> '') AS l FROM files))")
    label = f"'part_' || lpad(CAST((row_number() OVER (ORDER BY file_id) - 1) // {SHARD_ROWS} AS VARCHAR), 4, '0')"
    spread = f"{lexed(JAVA)}, {_TYPED_BLANKS}"
    tokenized = (f"whole AS (SELECT file_id, trim(string_agg(coalesce(f.word, l.unicode), chr(10) ORDER BY line_no), {_STRIP}) AS s FROM split_lines l "
                 f"LEFT JOIN final f ON f.original = l.unicode GROUP BY file_id), tokenized AS (SELECT file_id, list_transform(string_split(s, ''), lambda c: {code_id('c')}) AS ids FROM whole)")
    used = f"least(len(ids), {MAX_LENGTH})"
    pad = lambda value: f"list_transform(range({MAX_LENGTH} - {used}), lambda k: {value})"
    joined = lambda expr: f"array_to_string({expr}, ' ')"
    baseline = _baseline(SWEEP[-1])
    pairs = f"{_words()}, {pairs_of('w0', 'p0')}"
    sampled = f"(SELECT l.* FROM lines l JOIN (SELECT shard, row_number() OVER (ORDER BY shard) AS rn, count(*) OVER () AS k FROM (SELECT DISTINCT shard FROM encoded)) r USING (shard) WHERE rn <= ceil(k * {SAMPLE_PERCENT} / 100))"
    shown = ", ".join(text(v) for _, _, v in cd.BASE_VOCABULARY)
    special = values(list(enumerate(bpe.SPECIAL_TOKENS)), "bpe_id, token")
    vocabulary = (f"vocabulary AS (SELECT * FROM {special} UNION ALL SELECT {len(bpe.SPECIAL_TOKENS)} + i, chr(CAST({cd.PUA_START} + i AS INT)) FROM range({cd.BASE_SIZE}) AS r(i) "
                  f"UNION ALL SELECT unicode(sym) - {bpe.SYMBOL_START}, min(text) FROM merged GROUP BY sym)")
    each = lambda expr: f"list_transform(string_split(token, ''), lambda c: {expr})"
    number = f"unicode(c) - {cd.PUA_START}"
    ingested = (f"files AS (SELECT u.file_id, u.shard, CAST(NULL AS VARCHAR) AS path, c.content FROM ({clean} SELECT file_id, {LAYOUT} AS content FROM kept GROUP BY file_id) c "
                f"JOIN ({JUDGED} SELECT file_id, shard FROM judged WHERE balanced AND has_type AND NOT hashed) u USING (file_id))")
    found = {
        # Sources, files, names
        "scan_source_files": f"{files} SELECT file_id, path, content FROM files",
        "suffix_filter": f"{files} SELECT file_id, path FROM files WHERE path LIKE '%.java'",
        "file_names": f"{files} SELECT file_id, {FILE_NAME} AS file_name FROM files",
        "hash_name_filter": f"{files} SELECT file_id, {FILE_NAME} AS file_name FROM files WHERE NOT {HASH_NAME}",
        "encoded_paths": f"{files} SELECT file_id, shard || '/' || regexp_extract(path, '\\A((?:[\\s\\S]*/)?)[^/]*\\z', 1) || replace(regexp_extract(path, '([^/]*)\\z', 1), '.java', '') || '_unicode.txt' AS file_path FROM files",
        "shard_assignment": f"{files} SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS row_index, {label} AS shard FROM files",
        "shard_count": f"{files} SELECT count(*) AS files, CAST(ceil(count(*) / {SHARD_ROWS}) AS BIGINT) AS shards FROM files",
        "files_per_shard": f"{files} SELECT shard, count(*) AS files FROM files GROUP BY ROLLUP (shard)",
        "shard_ranks": f"{sharded} SELECT shard, rn, k FROM ranks",
        "sample_shards": f"{sharded} SELECT file_id, f.shard FROM files f JOIN ranks r ON f.shard = r.shard WHERE rn <= ceil(k * {SAMPLE_PERCENT} / 100)",
        "training_files": f"{sharded} SELECT file_id, f.shard FROM files f JOIN ranks r ON f.shard = r.shard WHERE rn <= floor(k * {TRAIN_RATIO})",
        "evaluation_files": f"{sharded} SELECT file_id, f.shard FROM files f JOIN ranks r ON f.shard = r.shard WHERE rn > floor(k * {TRAIN_RATIO})",
        "split_overlap": f"""{sharded}, sides AS (SELECT f.shard, max(CASE WHEN rn <= floor(k * {TRAIN_RATIO}) THEN 1 ELSE 0 END) AS t, max(CASE WHEN rn > floor(k * {TRAIN_RATIO}) THEN 1 ELSE 0 END) AS e FROM files f JOIN ranks r ON f.shard = r.shard GROUP BY f.shard)
            SELECT sum(t)::BIGINT AS training, sum(e)::BIGINT AS evaluation, sum(t * e)::BIGINT AS shared FROM sides""",
        "count_first_folders": f"{sharded} SELECT count(*) AS files FROM files f JOIN ranks r ON f.shard = r.shard WHERE rn <= floor(k * 0.9)",
        "count_training_files": f"{sharded} SELECT count(*) AS files FROM files f JOIN ranks r ON f.shard = r.shard WHERE rn <= floor(k * {TRAIN_RATIO}) AND path LIKE '%.txt'",
        "training_steps": f"{sharded} SELECT count(*) AS files, count(*) // {BATCH} AS steps FROM files f JOIN ranks r ON f.shard = r.shard WHERE rn <= floor(k * {TRAIN_RATIO})",
        "processed_files": f"{files} SELECT file_id, 'processed_' || shard AS shard, CAST(strlen(content) AS BIGINT) AS size FROM files",
        # Text
        "normalize_newlines": f"WITH {JAVA} SELECT file_id, {NORMAL} AS content FROM files",
        "strip_header": f"WITH {headless(JAVA)} SELECT file_id, content FROM files",
        "corpus_lines": f"{files}, {lines} SELECT file_id, shard, line_no, line FROM lines",
        "corpus_text": f"{files}, {lines} SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS content FROM lines GROUP BY file_id",
        "non_blank_files": f"WITH {compacted(BLANKED)} SELECT file_id, content FROM files",
        "line_counts": f"{files}, {lines} SELECT line, count(*) AS n FROM lines GROUP BY line",
        "fill_in_the_middle": f"""{files}, cut AS (SELECT file_id, content, string_split(regexp_replace(content, '\\n+\\z', ''), chr(10)) AS l FROM files),
            drawn AS (SELECT *, len(l) AS n, {draw('start', 'len(l) // 2')} + len(l) // 4 AS s, {draw('length', 'len(l) // 4')} AS d FROM cut),
            sized AS (SELECT *, s + least(d, n - s) AS e FROM drawn)
            SELECT file_id, CASE WHEN n < 3 THEN content ELSE '<PRE>' || {part('0', 's')} || '<MID>' || {part('s', 'e')} || '<SUF>' || {part('e', 'n')} END AS content FROM sized""",
        # Tokens
        "lex_tokens": f"{java} SELECT file_id, pos, token_type, text FROM tokens",
        "lex_markup": f"{pages} SELECT token_type, text, count(*) AS n FROM tokens GROUP BY ALL",
        "token_categories": f"{java} SELECT file_id, pos, category FROM tokens",
        "significant_tokens": f"{pages} SELECT file_id, pos, token_type, text FROM tokens WHERE category <> 'COMMENT' AND NOT (token_type = 'WS' AND text NOT LIKE '%' || chr(10) || '%')",
        "token_line_numbers": f"{java} SELECT file_id, pos, coalesce(sum(CASE WHEN token_type = 'WS' THEN length(text) - length(replace(text, chr(10), '')) ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM tokens",
        "neighbour_types": f"{java} SELECT file_id, pos, lag(token_type) OVER o AS previous_type, lead(token_type) OVER o AS next_type FROM tokens WINDOW o AS (PARTITION BY file_id ORDER BY pos)",
        "bracket_balance": f"""{java}, steps AS (SELECT file_id, pos, k, sum(CASE WHEN text = o THEN 1 WHEN text = c THEN -1 ELSE 0 END) OVER (PARTITION BY file_id, k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth
            FROM tokens, (VALUES (1, '(', ')'), (2, '[', ']'), (3, '{{', '}}')) AS b(k, o, c)),
            ends AS (SELECT file_id, k, min(depth) AS lowest, arg_max(depth, pos) AS final FROM steps GROUP BY file_id, k)
            SELECT file_id, least(0, min(lowest)) AS min_depth, sum(abs(final)) AS end_depth FROM ends GROUP BY file_id""",
        "retokenize": f"{java} SELECT file_id, regexp_replace(string_agg(text, ' ' ORDER BY pos), {_TRIM}, '', 'g') AS content FROM tokens GROUP BY file_id",
        # Cleaning and garbage
        "strip_comments": f"WITH {JAVA}, cut AS (SELECT file_id, regexp_extract_all(content, {PATTERN}) AS a FROM files) SELECT file_id, array_to_string(list_transform(a, lambda t: CASE WHEN t LIKE '/*%' OR t LIKE '//%' THEN ' ' ELSE t END), '') AS content FROM cut",
        "format_files": f"{java}, {PLAIN} SELECT file_id, {LAYOUT} AS content FROM kept GROUP BY file_id",
        "remove_annotations": f"{java}, {UNANNOTATED} SELECT file_id, {LAYOUT} AS content FROM kept GROUP BY file_id",
        "clean_files": f"{clean} SELECT file_id, {LAYOUT} AS content FROM kept GROUP BY file_id",
        "declared_files": f"{JUDGED} SELECT file_id FROM judged WHERE has_type OR NOT balanced",
        "balanced_files": f"{JUDGED} SELECT file_id FROM judged WHERE balanced",
        "garbage_filter": f"{JUDGED} SELECT file_id FROM judged WHERE NOT hashed AND (has_type OR NOT balanced)",
        "dataset_size": f"{JUDGED} SELECT count(*) AS files, CAST(sum(strlen(r.content)) AS BIGINT) AS total_bytes FROM judged j JOIN raw r USING (file_id) WHERE NOT hashed AND (has_type OR NOT balanced)",
        # Statistics
        "file_token_stats": f"{java}, s AS (SELECT file_id, {_STATS} FROM tokens GROUP BY file_id) SELECT file_id, {_AS_BIGINT} FROM s",
        "corpus_token_stats": f"{pages}, s AS (SELECT {_STATS} FROM tokens) SELECT {_AS_BIGINT} FROM s",
        "merged_token_stats": f"{java}, s AS (SELECT {_STATS} FROM tokens) SELECT {_AS_BIGINT} FROM s",
        "token_stats_report": f"{java}, s AS (SELECT {_STATS} FROM tokens), w AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _COLUMNS)}, CASE WHEN string_literals > 0 THEN CAST(literal_chars AS DOUBLE) / string_literals ELSE 0 END AS avg_literal_chars, CASE WHEN identifier > 0 THEN CAST(identifier_chars AS DOUBLE) / identifier ELSE 0 END AS avg_identifier_chars FROM s) UNPIVOT w ON COLUMNS(*) INTO NAME metric VALUE value",
        "category_counts": f"{spread} SELECT category, CAST(n AS BIGINT) AS n FROM spread",
        "streamed_category_counts": f"{spread} SELECT category, CAST(n AS BIGINT) AS n FROM spread",
        "value_frequencies": f"{java}, {FREQ} SELECT kind, item, cnt FROM freq",
        "streamed_frequencies": f"{lexed(FILES)}, {FREQ} SELECT kind, item, cnt FROM freq",
        "frequency_ranking": f"{java}, {FREQ} SELECT kind, item, cnt FROM freq ORDER BY kind, cnt DESC, item DESC",
        "weighted_frequencies": f"{java}, {FREQ} SELECT kind, item, cnt, length(item) * cnt AS weight FROM freq",
        "weighted_ranking": f"{java}, {FREQ} SELECT kind, item, length(item) * cnt AS weight FROM freq ORDER BY weight DESC, item, kind LIMIT {TOP}",
        "top_identifiers": f"{lexed(FILES)}, {FREQ} SELECT item, cnt FROM freq WHERE kind = 'identifiers' ORDER BY cnt DESC, item DESC LIMIT {TOP}",
        "missing_identifiers": f"{lexed(FILES)}, {FREQ}, {vocab} SELECT item, cnt FROM freq WHERE kind = 'identifiers' AND item NOT IN (SELECT key FROM vocab)",
        "extended_vocabulary": f"{lexed(FILES)}, {FREQ}, {vocab}, added AS (SELECT item, cnt FROM freq WHERE kind = 'identifiers' AND item NOT IN (SELECT key FROM vocab) ORDER BY cnt DESC, item DESC LIMIT {EXTRA_IDS}) SELECT token_id, key, value FROM vocab UNION ALL SELECT {cd.BASE_SIZE - 1} + row_number() OVER (ORDER BY cnt DESC, item DESC), item, item FROM added",
        # Codec
        "encode_files": f"{enc} SELECT file_id, shard, unicode FROM encoded",
        "encode_java": f"{encoded(JAVA)} SELECT file_id, unicode FROM encoded",
        "encode_tokens": f"{pages}, e AS (SELECT file_id, pos, text, {ENCODED} AS encoded FROM tokens) SELECT * FROM e WHERE encoded <> ''",
        "encoded_lines": f"{encoded_lines(JAVA)} SELECT file_id, line_no, unicode FROM lines",
        "token_ids": f"{java}, {vocab} SELECT t.file_id, t.pos, v.token_id FROM tokens t JOIN vocab v ON v.key = '!LEX_' || t.token_type",
        "identifier_ids": f"""{lexed(FILES)}, {FREQ}, {vocab}, added AS (SELECT item, {cd.BASE_SIZE - 1} + row_number() OVER (ORDER BY cnt DESC, item DESC) AS token_id FROM
            (SELECT * FROM freq WHERE kind = 'identifiers' AND item NOT IN (SELECT key FROM vocab) ORDER BY cnt DESC, item DESC LIMIT {EXTRA_IDS})),
            keys AS (SELECT item AS key, token_id FROM added UNION ALL SELECT key, token_id FROM vocab WHERE key NOT LIKE '!LEX_%'),
            spelled AS (SELECT file_id, pos, text, chr({cd.PUA_START + cd.IDENTIFIER_ID}) || {SPELL} AS s FROM tokens WHERE category = 'IDENTIFIER')
            SELECT file_id, pos, coalesce(CAST(k.token_id AS VARCHAR), {ids_text('s')}) AS ids FROM spelled LEFT JOIN keys k ON k.key = spelled.text""",
        "ids_to_characters": f"{encoded_lines(FILES)} SELECT file_id, line_no, unicode FROM lines",
        "characters_to_ids": f"{encoded_lines(FILES)} SELECT file_id, line_no, {ids_text('unicode')} AS ids FROM lines",
        "alphabet_filter": f"{enc} SELECT file_id, regexp_replace(unicode || path, '[^' || chr({cd.PUA_START}) || '-' || chr({cd.PUA_START + cd.BASE_SIZE - 1}) || ']', '', 'g') AS unicode FROM encoded",
        "decode_characters": f"{encoded(JAVA)}, {decoded(char_rows('encoded', 'unicode'))} SELECT file_id, code FROM decoded",
        "decode_ids": f"{enc}, {decoded(char_rows('encoded', 'unicode'))} SELECT file_id, code FROM decoded",
        "looked_up_ids": f"{enc}, {vocab}, i AS (SELECT file_id, unnest(list_transform(list_filter(string_split(unicode, ''), lambda c: c <> chr(10)), lambda c: unicode(c) - {cd.PUA_START})) * 2 AS token_id FROM encoded) SELECT token_id, coalesce(value, '<?>') AS value, count(*) AS n FROM i LEFT JOIN vocab USING (token_id) GROUP BY ALL",
        "cut_at_line_end": f"{enc} SELECT file_id, string_split(unicode, chr({cd.PUA_START}))[1] || chr({cd.PUA_START}) AS unicode FROM encoded",
        # Byte pairs
        "line_multiset": f"{encoded_lines(FILES)} SELECT unicode AS word, count(*) AS n FROM lines GROUP BY 1",
        "pair_counts": f"{pairs} SELECT pair, CAST(c AS BIGINT) AS cnt FROM p0",
        "frequent_pairs": f"{pairs} SELECT pair, CAST(c AS BIGINT) AS cnt FROM p0 WHERE c >= {bpe.MIN_FREQUENCY}",
        "best_pairs": f"{pairs} SELECT pair, CAST(c AS BIGINT) AS cnt FROM p0 ORDER BY c DESC, pair LIMIT {TOP}",
        "train_merges": f"{_bpe()} SELECT rank, {code_id('left(pair, 1)')} AS left_id, {code_id('right(pair, 1)')} AS right_id, {code_id('sym')} AS new_id FROM merged",
        "encode_bpe": f"{_bpe()} SELECT file_id, line_no, array_to_string(list_transform(string_split(f.word, ''), lambda c: {code_id('c')}), ' ') AS ids FROM lines JOIN final f ON f.original = lines.unicode",
        "corpus_token_count": f"{_bpe()} SELECT CAST(sum(n) AS BIGINT) AS lines, CAST(sum(n * length(word)) AS BIGINT) AS tokens, CAST(sum(n * length(word)) AS DOUBLE) / sum(n) AS tokens_per_line FROM final",
        "folder_token_count": f"{_bpe()} SELECT (SELECT count(DISTINCT shard) FROM lines) AS folders, (SELECT count(DISTINCT file_id) FROM lines) AS files, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(n * length(word)) AS BIGINT) AS tokens, CAST(sum(n * length(word)) AS DOUBLE) / sum(n) AS tokens_per_line FROM final",
        "running_token_rate": f"""{_bpe()}, sized AS (SELECT file_id, line_no, length(f.word) AS size FROM lines JOIN final f ON f.original = lines.unicode),
            running AS (SELECT row_number() OVER o AS lines, sum(size) OVER o AS tokens FROM sized WINDOW o AS (ORDER BY file_id, line_no ROWS UNBOUNDED PRECEDING))
            SELECT lines, CAST(tokens AS BIGINT) AS tokens, CAST(tokens AS DOUBLE) / lines AS tokens_per_line FROM running WHERE lines % {REPORT_EVERY} = 0""",
        "baseline_token_count": f"WITH RECURSIVE {baseline} SELECT total_tokens FROM baseline",
        "vocabulary_sweep": f"{_bpe()} {_sizes()}",
        "baseline_improvement": f"{_bpe()}, {baseline}, series AS MATERIALIZED ({_sizes()}) SELECT s.vocab_size, b.total_tokens - s.total_tokens AS fewer_tokens, CAST(b.total_tokens - s.total_tokens AS DOUBLE) / b.total_tokens * 100 AS improvement_pct FROM series s JOIN baseline b USING (vocab_size)",
        "nearest_to_baseline": f"{_bpe()}, {baseline}, series AS MATERIALIZED ({_sizes()}) SELECT s.vocab_size, s.total_tokens, CAST(b.vocab_size - s.vocab_size AS DOUBLE) / b.vocab_size * 100 AS saving_pct FROM series s, baseline b ORDER BY abs(s.total_tokens - b.total_tokens), s.vocab_size LIMIT 1",
        "truncation_report": f"{_bpe()}, {tokenized} SELECT count(*) AS files, count(*) FILTER (len(ids) > {MAX_LENGTH}) AS truncated_files, CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(sum(greatest(len(ids) - {MAX_LENGTH}, 0)) AS BIGINT) AS lost_tokens FROM tokenized",
        "split_content_overlap": f"""{sharded}, sides AS (SELECT content, max(rn <= floor(k * {TRAIN_RATIO})) AS t, max(rn > floor(k * {TRAIN_RATIO})) AS e, count(*) AS n FROM files f JOIN ranks r ON f.shard = r.shard GROUP BY content)
            SELECT count(*) FILTER (t) AS training_texts, count(*) FILTER (e) AS evaluation_texts, count(*) FILTER (t AND e) AS shared_texts, CAST(coalesce(sum(n) FILTER (t AND e), 0) AS BIGINT) AS shared_files FROM sides""",
        "sampled_training": f"""{_bpe(SAMPLE_MERGES, sampled)}, steps AS (SELECT list(pair || sym ORDER BY rank) AS s FROM merged),
            ranked AS (SELECT shard, row_number() OVER (ORDER BY shard) AS rn, count(*) OVER () AS k FROM (SELECT DISTINCT shard FROM encoded)),
            counted AS (SELECT unicode, rn <= floor(k * {TRAIN_RATIO}) AS t, count(*) AS n FROM lines JOIN ranked USING (shard) GROUP BY ALL),
            sized AS (SELECT t, n, length(list_reduce(list_prepend(unicode, s), lambda w, m: replace(w, left(m, 2), right(m, 1)))) AS size FROM counted, steps)
            SELECT CASE WHEN t THEN 'training' ELSE 'evaluation' END AS side, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(n * size) AS BIGINT) AS tokens FROM sized GROUP BY t""",
        "readable_vocabulary": f"""{_bpe()}, {vocabulary}, split AS (SELECT bpe_id, token, list_filter({each(f"([{shown}])[{number} + 1]")}, lambda p: NOT contains(p, 'IDENTIFIER')) AS p FROM vocabulary)
            SELECT bpe_id, CASE WHEN bpe_id < {len(bpe.SPECIAL_TOKENS)} THEN token WHEN len(p) = 1 THEN p[1] ELSE array_to_string(p, ' + ') || ' -> "' || array_to_string(p, '') || '"' END || chr(9) || bpe_id AS line FROM split""",
        "id_vocabulary": f"{_bpe()}, {vocabulary} SELECT bpe_id, CASE WHEN bpe_id < {len(bpe.SPECIAL_TOKENS)} THEN token ELSE array_to_string({each(number)}, ' ') END || chr(9) || bpe_id AS line FROM vocabulary",
        "special_entries": f"SELECT bpe_id, token FROM {special} WHERE EXISTS (SELECT 1 FROM documents)",
        "trainer_vocabulary": f"{_bpe()}, {vocabulary} SELECT bpe_id, token FROM vocabulary",
        "stored_model": f"{_bpe()} SELECT rank, {code_id('left(pair, 1)')} AS left_id, {code_id('right(pair, 1)')} AS right_id, {code_id('sym')} AS new_id FROM merged",
        # Written and read again
        "written_shards": f"{files} SELECT file_id, {label} AS shard, md5(content) AS content_md5 FROM files",
        "written_cleaned": f"{files} SELECT file_id, 'processed_' || shard AS shard, CAST(strlen(content) AS BIGINT) AS size, md5(content) AS content_md5 FROM files",
        "written_values": f"{java}, {FREQ} SELECT kind, item AS value, cnt AS n FROM freq",
        "written_encoded": f"{enc} SELECT shard, shard || '/' || regexp_extract(path, '\\A((?:[\\s\\S]*/)?)[^/]*\\z', 1) || replace(regexp_extract(path, '([^/]*)\\z', 1), '.java', '') || '_unicode.txt' AS file_path, md5(unicode) AS unicode_md5 FROM encoded",
        "written_corpus": f"{files}, {lines} SELECT line, count(*) AS n FROM lines GROUP BY line",
        "archived_files": f"{files} SELECT shard, path, md5(content) AS content_md5 FROM (SELECT * REPLACE ({label} AS shard) FROM files) WHERE path LIKE '%.java'",
        "unreadable_entries": f"{files} SELECT shard, path, 'invalid UTF-8' AS error FROM (SELECT * REPLACE ({label} AS shard) FROM files) WHERE file_id % 9 = 0",
        "archived_ids": f"""{enc}, listed AS (SELECT {label} AS shard, file_id, list_transform(list_filter(string_split(unicode, ''), lambda c: c <> chr(10)), lambda c: unicode(c) - {cd.PUA_START}) AS ids FROM encoded)
            SELECT shard, regexp_replace(string_agg(array_to_string(list_transform(ids, lambda i: i || CASE WHEN i = 0 THEN chr(10) ELSE ' ' END), ''), '' ORDER BY file_id), {_TRIM}, '', 'g') AS id_text FROM listed GROUP BY shard""",
        "text_files": f"{files} SELECT 'processed_' || coalesce(shard, 'none') AS shard, file_id || '.txt' AS path, md5(content) AS content_md5 FROM files",
        "frequency_file": f"{lexed(FILES)}, {FREQ} SELECT item, cnt, length(item) * cnt AS weight FROM freq WHERE kind = 'identifiers'",
        "restarted_ingest": f"{encoded(ingested)} SELECT file_id, shard, md5(unicode) AS unicode_md5 FROM encoded",
        "training_examples": f"{_bpe()}, {tokenized} SELECT file_id, {joined(f'list_concat(ids[1:{MAX_LENGTH}], {pad(bpe.PAD_ID)})')} AS input_ids, {joined(f'list_concat(list_transform(ids[1:{MAX_LENGTH}], lambda x: 1), {pad(0)})')} AS attention_mask, {joined(f'list_concat(ids[1:{MAX_LENGTH}], {pad(-100)})')} AS labels FROM tokenized",
    }
    escaped = "replace(value, chr(10), chr(92) || 'n')"
    found["id_map_file"] = f"SELECT CAST(token_id AS VARCHAR) AS token_id, rtrim({escaped}, {_STRIP}) AS text FROM ({found['extended_vocabulary']})"
    return found
