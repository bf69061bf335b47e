"""DuckDB counterparts of the registered queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op2_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
hit AS (
  SELECT p.doc_id, p.i, p.n, g.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)) p
  JOIN g ON p.gram = g.gram AND p.n = g.n),
words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit))
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op1_chat_formatting"] = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]')) AS tokens,
         8 + length(role) + length(text)
         + len(regexp_extract_all(role, '\\[elbn]')) + len(regexp_extract_all(text, '\\[elbn]'))
         + len(regexp_extract_all(role, '</?s>|\[/?INST\]|<</?SYS>>|\n'))
         + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM src),
p AS (
  SELECT *, tokens >= 512 AS is_long,
         coalesce(sum(tokens) OVER w, 0) AS opens, coalesce(sum(CAST(tokens >= 512 AS INT)) OVER w, 0) AS longs
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE WHEN is_long THEN 0 ELSE opens // 1536 END AS stride FROM p),
w AS (SELECT conv_id, longs, is_long, stride, min(pos) AS first_pos, min(opens) AS opens FROM s GROUP BY ALL),
extra AS (
  SELECT w.conv_id, s.chars FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
    AND s.pos BETWEEN w.first_pos - 2 AND w.first_pos - 1 AND s.opens >= w.opens - 256
    AND NOT (s.pos = 1 AND s.role = 'system')
  UNION ALL
  SELECT w.conv_id, s.chars FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
    AND w.first_pos > 1 AND s.pos = 1 AND s.role = 'system'),
more AS (SELECT conv_id, sum(chars) AS chars FROM extra GROUP BY conv_id),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars
  FROM s GROUP BY conv_id)
SELECT c.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(c.chars + coalesce(more.chars, 0) AS BIGINT) AS formatted_chars
FROM c LEFT JOIN more ON more.conv_id IS NOT DISTINCT FROM c.conv_id
"""

SQL["op10_warc_round_trip"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""

SQL["op12_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS raw
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT doc_id, pos, raw, translate(trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first_doc <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (first_doc IS NULL OR first_doc = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

# CRC-32 of an ASCII string, bit by bit.
_CRC32 = """(xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda s, c: list_reduce([xor(s, c)] || list_transform(range(8), lambda i: CAST(0 AS BIGINT)),
    lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295))"""

SQL["op13_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, HASH % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT conv_id, base, h, least(h, (SELECT count(*) FROM t WHERE t.conv_id = c.base)) AS heads FROM c),
r AS (
  SELECT n.conv_id, t.pos, role, text FROM n JOIN t ON t.conv_id = n.base AND t.pos <= n.heads
  UNION ALL SELECT n.conv_id, t.pos - h + heads, role, text FROM n JOIN t ON t.conv_id = n.conv_id AND t.pos > h),
x AS (
  SELECT conv_id, pos AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         sha256(string_agg(sha256(role) || sha256(text), '' ) OVER (PARTITION BY conv_id ORDER BY pos)) AS key
  FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM n),
p AS (SELECT *, lag(key) OVER w AS parent, lead(key) OVER w IS NULL AS is_end FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
node AS (
  SELECT key, depth, parent, words, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM p GROUP BY ALL),
kids AS (SELECT parent AS key, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY 1),
subtree AS (
  SELECT up.key, sum((node.n_convs - 1) * node.words) AS saved_tokens, count(*) FILTER (kids.key IS NULL) AS n_leaves
  FROM node LEFT JOIN kids ON kids.key = node.key JOIN p up ON up.conv_id = node.conv_id AND up.depth <= node.depth GROUP BY 1)
SELECT node.conv_id, node.depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node LEFT JOIN node above ON above.key = node.parent LEFT JOIN kids ON kids.key = node.key JOIN subtree ON subtree.key = node.key
""".replace("HASH", _CRC32.format("CAST(conv_id AS VARCHAR)"))


def _license_sql() -> str:
    from pulseweave.llm.licenses import COPYRIGHT_LINE, EQUIVALENT, KNOWN, PUNCTUATION, TITLE_LINE

    def canonical(text: str) -> str:
        sql = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        sql = f"regexp_replace({sql}, '{COPYRIGHT_LINE}', chr(10), 'g')"
        sql = f"regexp_replace({sql}, '{TITLE_LINE}', '', 'g')"
        sql = f"' ' || replace(trim(regexp_replace({sql}, '{PUNCTUATION}', ' ', 'g')), ' ', '  ') || ' '"
        for given, kept in EQUIVALENT:
            pair = [f" {w} ".replace(" ", "  ")[1:-1] for w in (given, kept)]
            sql = f"replace({sql}, '{pair[0]}', '{pair[1]}')"
        return f"trim(replace({sql}, '  ', ' '))"

    known = " UNION ALL ".join(
        "SELECT '{}' AS license, '{}' AS text".format(k, t.replace("'", "''")) for k, texts in KNOWN.items() for t in texts
    )
    return f"""
WITH known AS (SELECT min(license) AS license, sha256({canonical("text")}) AS digest FROM ({known}) GROUP BY 2),
whole AS (SELECT d.doc_id, sha256({canonical("d.text")}) AS digest FROM documents d),
lines AS (
  SELECT doc_id, {canonical("part")} AS form
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part FROM documents)),
found AS (
  SELECT l.doc_id, count(*) FILTER (form <> '') AS n_lines, count(k.license) AS n_license_lines,
         coalesce(string_agg(DISTINCT k.license, ',' ORDER BY k.license), '') AS line_licenses
  FROM lines l LEFT JOIN known k ON sha256(l.form) = k.digest GROUP BY l.doc_id)
SELECT w.doc_id, w.digest, k.license, n_lines, n_license_lines, line_licenses
FROM whole w LEFT JOIN known k USING (digest) JOIN found f ON f.doc_id = w.doc_id
"""


SQL["op5_license_scan"] = _license_sql()
