"""Plain-SQL twins of the queries that SQL can express, over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK_SPLIT = r"[^\x20\x09-\x0D]+"
_TEST_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


#: A window is removed where the smallest document it starts in is another one.
REPEATS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK_SPLIT}') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
s AS (SELECT doc_id, n, i, ws[i] AS word, CASE WHEN i + 12 <= n THEN array_to_string(ws[i:i + 12], ' ') END AS win FROM w),
f AS (SELECT win, min(doc_id) AS first FROM s WHERE win IS NOT NULL GROUP BY win),
m AS (SELECT s.*, coalesce(f.first < s.doc_id, false) AS again FROM s LEFT JOIN f USING (win)),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
 sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

#: Windows of every length that items have meet the documents' windows of that length.
CONTAMINATION = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower('text')}, '{_TEST_WORDS}') AS ws FROM benchmark),
bw AS (SELECT item, least(len(ws), 13) AS size, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i, ws FROM b WHERE len(ws) > 0),
t AS (SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS win FROM bw),
d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_TEST_WORDS}') AS ws FROM documents),
z AS (SELECT DISTINCT size FROM t),
dw AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS i, ws FROM d JOIN z ON len(ws) >= size),
o AS (SELECT doc_id, item, size, i FROM (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win FROM dw) JOIN t USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, size, i FROM o)) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT page_id, strlen(body) AS n, sha256(body) AS digest, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
 CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""

#: A turn's frame is ten code points before the role, nine before the text and four after it.
CHAT = r"""
WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') AS safe,
 regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') AS safe_role FROM c),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(23 + length(safe) + length(safe_role)) AS size
 FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
 sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM g"""

SIMILAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_BLANK_SPLIT}') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i, ws FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM x),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * same >= 75 * (na.size + nb.size - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT doc_id, min(reached) AS first FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, coalesce(first, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

#: CRC-32 bit by bit: the polynomial of the reversed form, over the characters of the decimal id.
TRIE = """
WITH c AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
 FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
 lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 9 AS h FROM c),
b AS (SELECT h.conv_id, coalesce(f.own[1:h.h], []) || h.own[h.h + 1:] AS path FROM h LEFT JOIN c f ON f.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, path[1:d] AS node, d, len(path) AS n FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM b)),
n AS (SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM m GROUP BY node, d),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[-1].t) ELSE 0 END AS saved FROM n LEFT JOIN k USING (node)),
u AS (SELECT node[1:d] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM a) GROUP BY ALL)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(a.n_convs AS BIGINT) AS n_convs, CAST(a.n_children AS BIGINT) AS n_children,
 CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM a JOIN u ON u.node = a.node LEFT JOIN a p ON a.depth > 0 AND p.node = a.node[1:a.depth - 1]"""
