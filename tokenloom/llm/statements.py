"""SQL of longer checks."""

from __future__ import annotations

from tokenloom.llm import chat


def _framed(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(length: str) -> str:
    return "sha256(" + " || ".join(_framed(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", length, "text")) + ")"


#: CRC-32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
    lambda held, c: list_reduce([xor(held, c), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"""


def _trees(name: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (tree, ord, leaf), and the siblings on each leaf's way up."""
    return f"""
        {name}_placed AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY ord NULLS FIRST, leaf) - 1 AS place,
                   count(*) OVER (PARTITION BY tree) AS width FROM {leaves}),
        {name}_nodes AS (
            SELECT tree, 0 AS level, place, leaf AS digest, width FROM {name}_placed
            UNION ALL
            SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (width + 1) // 2
            FROM {name}_nodes WHERE width > 1 GROUP BY tree, level, place // 2, width),
        {name}_siblings AS (
            SELECT p.tree, p.place, string_agg(n.digest, '' ORDER BY n.level) AS siblings
            FROM {name}_placed p JOIN {name}_nodes n ON n.tree = p.tree AND n.place = xor(p.place >> n.level, 1)
            GROUP BY p.tree, p.place)"""


def _walk(name: str, start: str) -> str:
    """From each row of ``start`` (its digest is the last column) up to the top, over the siblings of the original."""
    return f"""
        {name}_walk AS (
            SELECT *, place AS spot, 0 AS level, width AS wide FROM {start}
            UNION ALL
            SELECT w.* EXCLUDE (digest, spot, level, wide), CASE WHEN s.digest IS NULL THEN sha256(w.digest)
                       WHEN w.spot & 1 = 1 THEN sha256(s.digest || w.digest) ELSE sha256(w.digest || s.digest) END,
                   w.spot // 2, w.level + 1, (w.wide + 1) // 2
            FROM {name}_walk w LEFT JOIN {name}_nodes s ON s.tree = w.tree AND s.level = w.level AND s.place = xor(w.spot, 1)
            WHERE w.wide > 1)"""


MERKLE_MANIFEST = f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, doc_id AS ord, coalesce('v' || lang, '-') AS tree, {_leaf("CAST(n_chars AS VARCHAR)")} AS leaf,
                   {_leaf(f"CAST(n_chars::HUGEINT + ({_CRC} % 7 = 0)::INT AS VARCHAR)")} AS found
            FROM documents),
        {_trees("low", "leaves")},
        subroots AS (SELECT tree AS own, '' AS tree, tree AS ord, digest AS leaf FROM low_nodes WHERE width = 1),
        {_trees("top", "subroots")},
        begun AS (SELECT doc_id, tree, place, width, leaf, found AS digest FROM low_placed),
        {_walk("low", "begun")},
        continued AS (
            SELECT w.doc_id, w.tree AS own, w.place AS own_place, w.leaf, p.leaf AS subroot, p.tree, p.place, p.width, w.digest
            FROM low_walk w JOIN top_placed p ON p.own = w.tree WHERE w.wide = 1),
        {_walk("top", "continued")}
        SELECT doc_id, w.leaf, w.subroot, r.digest AS root, sha256(coalesce(l.siblings, '') || coalesce(t.siblings, '')) AS proof_sha256,
               w.digest AS folded_root, w.digest = r.digest AS verified
        FROM top_walk w JOIN top_nodes r ON r.width = 1
        LEFT JOIN low_siblings l ON l.tree = w.own AND l.place = w.own_place
        LEFT JOIN top_siblings t ON t.tree = w.tree AND t.place = w.place
        WHERE w.wide = 1"""


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}')"

#: Base32 of a SHA-1: five hexadecimal digits are four letters.
WARC = f"""
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        coded AS (
            SELECT *, array_to_string(list_transform(range(32), lambda k: substr('{_LETTERS}234567', CAST(
                (CAST('0x' || substr(hex, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
                   max(page_id) OVER (PARTITION BY hex) AS last
            FROM payloads)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM coded"""


def _escaped(value: str, *more: tuple[str, str]) -> str:
    """``value`` with every control string as two characters, in the order of the escapes."""
    out = f"replace({value}, chr({ord(chat.MARK)}), chr({ord(chat.MARK)}) || '0')"
    for letter, control in [*zip("abcdefgh", (f"'{x}'" for x in chat.CONTROL)), *more]:
        out = f"replace({out}, {control}, chr({ord(chat.MARK)}) || '{letter}')"
    return out


def chat_windows(budget: int = 512, history: int = 128) -> str:
    """Turns and targets are those of the table; the characters of the output follow from the windows' prefix sums."""
    return f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        framed AS (
            SELECT *, {len(chat.OPEN) + 1 + len(chat.CLOSE)} + length({_escaped('role', ('n', 'chr(10)'))}) + length({_escaped('text')}) AS chars,
                   len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) + {chat.MARK_TOKENS} AS tokens,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
            FROM turns),
        summed AS (
            SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY n) AS BIGINT) - tokens AS before,
                   max(CASE WHEN n = 1 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id) AS system
            FROM framed),
        cut AS (
            SELECT *, 2 * (before // {budget}) + CAST(before + tokens > (before // {budget} + 1) * {budget} AS INT) AS piece,
                   coalesce(sum(CASE WHEN n > 1 OR system IS NULL THEN chars END) OVER (
                       PARTITION BY conv_id ORDER BY before RANGE BETWEEN {history} PRECEDING AND 1 PRECEDING), 0)
                       + CASE WHEN n > 1 THEN coalesce(system, 0) ELSE 0 END AS lead
            FROM summed),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, piece ORDER BY n) = 1 AS leads FROM cut)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars + CASE WHEN leads THEN lead ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM placed GROUP BY conv_id"""


def decontamination(size: int = 10) -> str:
    """Windows of every number of words up to ``size`` by the words that follow; equal ones meet in a join."""
    words = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    following = [f"lead(word, {k}) OVER line" for k in range(size)]
    runs = " UNION ALL ".join(f"SELECT row, pos, {k} AS size, {' || chr(32) || '.join(f'w{i}' for i in range(k))} AS run FROM led WHERE w{k - 1} IS NOT NULL"
                              for k in range(1, size + 1))
    led = ", ".join(f"{x} AS w{k}" for k, x in enumerate(following))
    return f"""
        WITH texts AS (
            SELECT 'd' AS side, row_number() OVER () AS row, doc_id, NULL AS item, {words} AS words FROM documents
            UNION ALL
            SELECT 'b', -row_number() OVER (), NULL, coalesce(CAST(item_id AS VARCHAR), 'null'), {words} FROM benchmark),
        each_word AS (
            SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
        led AS (SELECT row, pos, {led} FROM each_word WINDOW line AS (PARTITION BY row ORDER BY pos)),
        runs AS ({runs}),
        wanted AS (
            SELECT DISTINCT item, size, run FROM runs JOIN texts USING (row)
            WHERE side = 'b' AND size = least(len(words), {size})),
        hits AS (SELECT row, pos, size, item FROM runs JOIN wanted USING (size, run) WHERE row > 0),
        marked AS (
            SELECT row, count(DISTINCT place) AS n_hit
            FROM (SELECT row, unnest(range(pos, pos + size)) AS place FROM (SELECT DISTINCT row, pos, size FROM hits)) GROUP BY row),
        items AS (
            SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM texts LEFT JOIN marked USING (row) LEFT JOIN items USING (row) WHERE side = 'd'"""
