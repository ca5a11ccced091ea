"""DuckDB SQL for those training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

NEAR_DUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.v) AS component_id, s.doc_id = min(r.v) AS kept
FROM s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.s
"""

_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '(<|\[)(/?(?:s>|INST\]))', '\1\\\2', 'g')"

CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + 9 + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS BIGINT) AS weight FROM s1),
s3 AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
    CAST(sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS among FROM s2),
k AS (SELECT source_size / weight AS level, rank AS k_rank, remaining AS k_remaining, among AS k_among FROM s3
      WHERE 3 * source_size * among > remaining * weight ORDER BY 1, 2 LIMIT 1),
s4 AS (
  SELECT source, source_size, rank, CAST(CASE WHEN k_rank IS NULL OR source_size / weight < level OR (source_size / weight = level AND rank < k_rank)
    THEN 3 * source_size ELSE (weight * k_remaining) / k_among END AS DOUBLE) AS target FROM s3 LEFT JOIN k ON true),
s5 AS (SELECT *, CAST(round(target) AS BIGINT) AS share FROM s4),
s6 AS (SELECT *, CAST(sum(share) OVER (ORDER BY rank) AS BIGINT) AS upto, CAST(sum(share) OVER () AS BIGINT) AS everything FROM s5),
iv AS (SELECT rank, CAST(floor((upto - share) / everything * 2147483648.0::DOUBLE) AS BIGINT) AS lo, CAST(floor(upto / everything * 2147483648.0::DOUBLE) AS BIGINT) AS hi FROM s6 WHERE everything > 0),
t AS (SELECT slot, (slot % 2147483648) * 1327217885 % 2147483648 AS p FROM range(0, CAST((SELECT (sum(size) + 63) // 64 FROM d) AS BIGINT)) r(slot)),
slots AS (SELECT rank, count(*) AS slots FROM t JOIN iv ON lo <= p AND p < hi GROUP BY rank),
pos AS (
  SELECT d.*, rank, s4.source_size, target, coalesce(slots, 0) AS slots,
    CAST(sum(d.size) OVER (PARTITION BY rank ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS a
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source LEFT JOIN slots USING (rank))
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(a + size, 64 * slots) - a) + greatest(0, least(a + source_size + size, 64 * slots) - a - source_size)
  + greatest(0, least(a + 2 * source_size + size, 64 * slots) - a - 2 * source_size) AS BIGINT) AS taken
FROM pos
"""

ANN = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, 
    sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i])))) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""

WARC = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS target FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN target END AS refers_to
FROM m
"""

# CRC-32 of an id in decimal, bit by bit
_CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), "
    "lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295)"
)

TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    md5(length(role) || ':' || role || text) AS digest, octet_length(encode(text)) AS size FROM t),
c AS (SELECT DISTINCT conv_id, {_CRC} % 9 AS h FROM t),
r AS (
  SELECT c.conv_id, 0 AS own, pos, digest, size FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, digest, size FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(digest, '') OVER w) AS key, size
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, md5(''), 0 FROM c),
q AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (
  SELECT key, depth, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, min(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM q GROUP BY key, depth),
k AS (SELECT parent AS key, count(*) AS n_children FROM n GROUP BY parent),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
below AS (SELECT DISTINCT a.key AS top, b.key AS key FROM q a JOIN q b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
s AS (
  SELECT top AS key, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
  FROM below JOIN f USING (key) GROUP BY top)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN s USING (key) LEFT JOIN n up ON up.key = f.parent
"""
