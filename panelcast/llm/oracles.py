"""DuckDB SQL of the operators that SQL can express, written from their contracts and not from their plans."""

from panelcast.llm.licenses import scan_sql

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^ \\t\\n\\x0B\\f\\r]+')"


LINES = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS line FROM cut),
keyed AS (SELECT *, {lower(f"trim(line, {SPACE})")} AS key FROM lines),
held AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, i, line, last_doc IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

ESCAPE = r"regexp_replace(regexp_replace({}, '([\\#])', '\\\1', 'g'), '</', '<\\/', 'g')"
CHATS = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length({ESCAPE.format("role")}) + len(regexp_extract_all(role, ':')) + 2 + length({ESCAPE.format("text")}) + 9) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(lower("coalesce(text, '')"))} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(g, ' ') AS g
  FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id, min(b) = d.doc_id AS kept
FROM documents d JOIN reach ON a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

BENCH_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS = f"""
WITH bw AS (SELECT item_id, {BENCH_WORDS.format(lower("coalesce(text, '')"))} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g
  FROM (SELECT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: w[i : i + 9]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM bw)),
dw AS (SELECT doc_id, {BENCH_WORDS.format(lower("coalesce(text, '')"))} AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM places),
hits AS (SELECT doc_id, i, h.n, item_id FROM grams h JOIN windows x ON h.g = x.g AND h.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

REPEATS = f"""
WITH w AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM starts),
firsts AS (SELECT g, min(doc_id) AS first_doc FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (g) WHERE doc_id > first_doc),
single AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
kept AS (SELECT s.doc_id, string_agg(word, ' ' ORDER BY s.p) AS kept FROM single s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.p = g.p GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN lost ON w.doc_id = lost.doc_id"""

TRIE = f"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
own AS (
  SELECT c, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS s FROM t GROUP BY c),
heads AS (
  SELECT c, s, c - c % 20 AS base, list_reduce(
    list_prepend(4294967295, list_transform(range(1, strlen(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM own),
cut AS (SELECT c, s, base, xor(crc, 4294967295) % 4 AS h FROM heads),
paths AS (
  SELECT x.c, list_concat(coalesce(b.s[:x.h], []), x.s[x.h + 1 :]) AS s FROM cut x LEFT JOIN own b ON b.c = x.base),
steps AS (SELECT c, unnest(range(len(s) + 1)) AS d, s FROM paths),
beginnings AS (SELECT c, d, s[:d] AS p, len(s) = d AS ended FROM steps),
nodes AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d > 0 THEN len({words("any_value(p)[d].t")}) ELSE 0 END AS own_saved
  FROM beginnings GROUP BY d, p),
linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[: n.d - 1]),
kids AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids USING (conv_id, d)),
sums AS (
  SELECT a.d, a.p, sum(x.own_saved) AS saved_tokens, count(*) FILTER (x.n_children = 0) AS n_leaves
  FROM counted x JOIN beginnings a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.d, a.p)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (d, p)"""

ORACLES: dict[str, str] = {
    "op2_line_dedup": LINES,
    "op3_chat_formatting": CHATS,
    "op4_minhash_forest": NEAR,
    "op5_benchmark_decontamination": LEAKS,
    "op6_license_scan": scan_sql("documents", "concat_ws('/', source, lang, doc_id::VARCHAR)"),
    "op10_substring_dedup": REPEATS,
    "op13_prefix_trie": TRIE,
}
