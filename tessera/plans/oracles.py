"""DuckDB SQL of the retrieval operators, by query name."""

from __future__ import annotations

from tessera.functions.text import ALIASES, KEEPS_DOT, NAME_RULES
from tessera.operators.extraction import CONFIDENCE, METRIC, ORGANIZATION, TECHNOLOGY, TRIGGERS
from tessera.sources.tables import SUFFIXES, TOOLS, VERBS


def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_str, values)) + "]"


def canonical(x: str) -> str:
    for pattern, by in NAME_RULES:
        x = f"regexp_replace({x}, {_str(pattern)}, {_str(by)}, 'g')"
    x = f"(CASE WHEN regexp_matches({x}, {_str(KEEPS_DOT)}) THEN {x} ELSE regexp_replace({x}, '\\.+$', '') END)"
    known = "MAP {" + ", ".join(f"{_str(k)}: {_str(v)}" for k, v in ALIASES.items()) + "}"
    return f"coalesce({known}[lower({x})], {x})"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_LETTERS = "translate(CAST({} AS VARCHAR), '0123456789', 'abcdefghij')"

REPORTS = f"""
reports AS (
  SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, CAST(page AS INTEGER) AS page_number, 'report_' || o_custkey || '.pdf' AS filename,
    CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'Report of ' || org END AS title,
    '# Order review ' || page || chr(10) || chr(10) || '## Summary.' || chr(10) || 'This year, ' || org || ' ' || verb || ' ' || partner || '.' || chr(10)
    || 'Its platform runs on ' || tool || '.' || chr(10) || chr(10) || '## Results.' || chr(10) || 'In total, ' || org || ' reported revenue of $' || amount
    || ' million, and margins rose by ' || (o_orderkey % 90) || '%.' || chr(10) AS text
  FROM (
    SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page,
      'Cust' || {_LETTERS.format("o_custkey")} || ' ' || {_list(SUFFIXES)}[o_custkey % {len(SUFFIXES)} + 1] AS org,
      'Nation' || {_LETTERS.format("c_nationkey")} || ' Systems LLC' AS partner,
      {_list(TOOLS)}[o_orderkey % {len(TOOLS)} + 1] AS tool, {_list(VERBS)}[o_orderkey % {len(VERBS)} + 1] AS verb,
      CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) AS amount
    FROM orders JOIN customer ON o_custkey = c_custkey))
"""


def _matches(pattern: str, kind: str, nth: int, raw: bool = False) -> str:
    name = _trim("m")
    canon = name if raw else canonical(name)
    return f"list_transform(regexp_extract_all(text, {_str(pattern)}, 1), lambda m: {{'c': {canon}, 'n': {name}, 't': '{kind}', 'f': {CONFIDENCE[kind]}::DOUBLE}})"


def _trigger_rows(found: str) -> str:
    return " UNION ALL ".join(
        f"SELECT chunk_id, doc_id, known, {1000 * n} + CAST(i AS INTEGER) - 1 AS position, '{kind}' AS relation_type, {_trim(f'regexp_extract_all(text, {_str(p)}, 1)[i]')} AS source_raw, "
        f"{_trim(f'regexp_extract_all(text, {_str(p)}, 2)[i]')} AS target_raw, CAST({c} AS DOUBLE) AS confidence FROM {found}, unnest(range(1, len(regexp_extract_all(text, {_str(p)}, 1)) + 1)) r(i)"
        for n, (kind, c, p) in enumerate(TRIGGERS)
    )


def _named(raw: str) -> str:
    return f"coalesce(list_filter(known, lambda k: contains({raw}, k))[1], {canonical(raw)})"


def extraction(source: str, p: str = "") -> str:
    """Tables of what the patterns find in ``source(chunk_id, doc_id, text)``, names prefixed with ``p``."""
    return f"""
{p}found0 AS (
  SELECT *, list_concat(list_concat({_matches(ORGANIZATION, "ORGANIZATION", 0)}, {_matches(TECHNOLOGY, "TECHNOLOGY", 1)}), {_matches(METRIC, "METRIC", 2, True)}) AS found FROM {source}),
{p}found AS (
  SELECT *, list_transform(list_filter(list_transform(range(1, len(found) + 1), lambda i: {{'c': found[i].c, 'first': list_position(list_transform(found, lambda e: e.c), found[i].c) = i}}), lambda e: e.first), lambda e: e.c) AS known FROM {p}found0),
{p}triggers AS ({_trigger_rows(p + "found")}),
{p}rel0 AS (SELECT *, {_named("source_raw")} AS source, {_named("target_raw")} AS target FROM {p}triggers),
{p}relations AS (SELECT *, source || ' ' || relation_type || ' ' || target AS description, CAST(1.0 AS DOUBLE) AS weight FROM {p}rel0),
{p}ments0 AS (
  SELECT chunk_id, doc_id, i - 1 AS ord, found[i].c AS canonical_name, found[i].n AS name, found[i].t AS entity_type, found[i].f AS confidence FROM {p}found, unnest(range(1, len(found) + 1)) r(i)
  UNION ALL SELECT chunk_id, doc_id, 1000000 + 2 * position, source, source_raw, 'CONCEPT', 0.8 FROM {p}relations WHERE length(source) > 2
  UNION ALL SELECT chunk_id, doc_id, 1000000 + 2 * position + 1, target, target_raw, CASE WHEN starts_with(target, '$') THEN 'METRIC' ELSE 'CONCEPT' END, 0.8 FROM {p}relations WHERE length(target) > 1),
{p}mentions AS (
  SELECT chunk_id, doc_id, canonical_name, ord, name, entity_type, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id, canonical_name ORDER BY ord) AS rn FROM {p}ments0) WHERE rn = 1)
"""


EXTRACTED = f"""
{REPORTS}, {extraction("reports")},
entities AS (
  SELECT canonical_name, name, entity_type, confidence, n_chunks, n_docs, chunk_id AS first_chunk FROM (
    SELECT *, row_number() OVER (PARTITION BY canonical_name ORDER BY chunk_id, ord) AS rn, count(DISTINCT chunk_id) OVER (PARTITION BY canonical_name) AS n_chunks,
      count(DISTINCT doc_id) OVER (PARTITION BY canonical_name) AS n_docs FROM mentions) WHERE rn = 1),
edges1 AS (
  SELECT source, target, relation_type, description, weight, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY source, target, relation_type ORDER BY chunk_id DESC, position DESC) AS rn FROM relations) WHERE rn = 1),
mention_edges AS (SELECT 'chunk:' || chunk_id AS src, canonical_name AS dst FROM mentions UNION ALL SELECT canonical_name, 'chunk:' || chunk_id FROM mentions),
near_edges AS (SELECT source AS src, target AS dst FROM edges1 UNION SELECT target, source FROM edges1 UNION SELECT * FROM mention_edges)
"""

TRADE = """
entities AS (
  SELECT 'customer:' || c_custkey AS canonical_name, c_name AS name, 'CUSTOMER' AS entity_type FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'SUPPLIER' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'NATION' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, r_name, 'REGION' FROM region),
rel AS (
  SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target, 'LOCATED_IN' AS relation_type FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF' FROM nation),
relations AS (SELECT *, source || ' ' || relation_type || ' ' || target AS description, CAST(1.0 AS DOUBLE) AS weight FROM rel),
both_ways AS (SELECT source AS src, target AS dst FROM relations UNION SELECT target, source FROM relations),
seeds AS (SELECT CAST(r_regionkey AS BIGINT) AS query_id, 'region:' || r_regionkey AS seed FROM region)
"""

CAPITALS = r"""
list_transform(list_filter(regexp_split_to_array(trim({}), '\s+'), lambda w: regexp_matches(w, '^\p{{Lu}}'))[1:4], lambda w: trim(w, ',.?'))
"""

LEXICON = f"""
lex AS (SELECT doc_id AS chunk_id, doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS canonical_name FROM documents),
bench0 AS (SELECT item_id, {CAPITALS.format("text")} AS s FROM benchmark),
bench AS (SELECT item_id AS query_id, CAST(i - 1 AS INTEGER) AS ord, s[i] AS seed FROM bench0, unnest(range(1, len(s) + 1)) r(i) WHERE s[i] <> '')
"""

_TOOL = f"{_list(TOOLS)}[n_nationkey % {len(TOOLS)} + 1]"
QUESTIONS = f"""
q0 AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'Nation' || {_LETTERS.format("n_nationkey")} || ' Systems LLC' AS org, {_TOOL} AS tool, {_LETTERS.format("n_nationkey")} AS nth FROM nation),
q AS (
  SELECT query_id, CASE WHEN query_id % 5 = 1 THEN 'Who says that Cust' || nth || ' Corp acquired ' || org || ' for ' || tool || '?' ELSE 'Who works with ' || org || ', and does it use ' || tool || '?' END AS question FROM q0),
{extraction("(SELECT query_id AS chunk_id, query_id AS doc_id, question AS text FROM q)", "q_")},
seeds AS (SELECT chunk_id AS query_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY ord) - 1 AS INTEGER) AS ord, canonical_name AS seed FROM q_mentions)
"""

_COSINE = "round(coalesce(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 0), 6)"
VECTORS = f"""
hits AS (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id, {_COSINE.format("a.embedding", "b.embedding")} AS score
      FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 5)
"""

LINES = r"""
raw AS (SELECT doc_id, page_number, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {}),
stripped AS (SELECT doc_id, page_number, CAST(line_no AS INTEGER) AS line_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM raw),
lines AS (SELECT *, CAST(len(regexp_split_to_array(line, '\s+')) AS INTEGER) AS n_words FROM stripped WHERE line <> '')
"""
_DOC_PAGES = "(SELECT doc_id, 1 AS page_number, text FROM documents)"

HEADINGS = r"""
marked AS (
  SELECT *, CASE WHEN starts_with(line, '# ') THEN trim(line[3:]) END AS a, CASE WHEN starts_with(line, '## ') THEN trim(line[4:]) END AS b FROM lines),
grouped AS (SELECT *, count(a) OVER (PARTITION BY doc_id ORDER BY page_number, line_no) AS g FROM marked),
headed AS (
  SELECT *, nullif(max(a) OVER (PARTITION BY doc_id, g), '') AS h1,
    nullif(last_value(b IGNORE NULLS) OVER (PARTITION BY doc_id, g ORDER BY page_number, line_no), '') AS h2 FROM grouped)
"""

FOLD = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS i, count(*) OVER (PARTITION BY doc_id, page_number) AS lines_n FROM lines),
fold AS (
  SELECT doc_id, page_number, i, line_no, lines_n, 0 AS start, n_words AS n, n_words AS upto, NULL::INTEGER AS c_start, NULL::INTEGER AS c_n, 0 AS closed FROM numbered WHERE i = 1
  UNION ALL
  SELECT x.doc_id, x.page_number, x.i, x.line_no, x.lines_n,
    CASE WHEN f.n + x.n_words > {size} AND f.n > 0 THEN f.upto - least({overlap}, f.n) ELSE f.start END,
    CASE WHEN f.n + x.n_words > {size} AND f.n > 0 THEN least({overlap}, f.n) + x.n_words ELSE f.n + x.n_words END,
    f.upto + x.n_words,
    CASE WHEN f.n + x.n_words > {size} AND f.n > 0 THEN f.start END, CASE WHEN f.n + x.n_words > {size} AND f.n > 0 THEN f.n END,
    f.closed + CASE WHEN f.n + x.n_words > {size} AND f.n > 0 THEN 1 ELSE 0 END
  FROM fold f JOIN numbered x ON x.doc_id = f.doc_id AND x.page_number = f.page_number AND x.i = f.i + 1),
ranges AS (
  SELECT doc_id, page_number, closed - 1 AS chunk_no, c_start AS start_word, c_n AS token_count, line_no AS last_line FROM fold WHERE c_n IS NOT NULL
  UNION ALL SELECT doc_id, page_number, closed, start, n, line_no FROM fold WHERE i = lines_n),
page_words AS (SELECT doc_id, page_number, regexp_split_to_array(string_agg(line, ' ' ORDER BY line_no), '\\s+') AS words FROM lines GROUP BY ALL),
chunks AS (
  SELECT r.doc_id, r.page_number, r.chunk_no, r.token_count, coalesce(h2, h1, 'General') AS section_title, array_to_string(words[start_word + 1 : start_word + token_count], ' ') AS text
  FROM ranges r JOIN page_words USING (doc_id, page_number) JOIN headed h ON h.doc_id = r.doc_id AND h.page_number = r.page_number AND h.line_no = r.last_line)
"""

GROUNDED = """
SELECT query_id, chunk_id, doc_id, mentioned_entities, graph_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, chunk_id) AS rank FROM (
    SELECT s.query_id, m.chunk_id, m.doc_id, string_agg(s.seed, ', ' ORDER BY s.ord, s.seed) AS mentioned_entities, round(CAST({score} AS DOUBLE), 6) AS graph_score
    FROM {seeds} s JOIN {mentions} m ON s.seed = m.canonical_name GROUP BY ALL)) WHERE rank <= 5
"""

BRIDGES = """
hit AS (SELECT DISTINCT chunk_id, doc_id, canonical_name FROM {mentions} WHERE canonical_name IN (SELECT seed FROM {seeds})),
ranked AS (
  SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.ord, a.chunk_id, b.chunk_id) AS nth, s.seed AS shared_entity,
    a.doc_id AS doc1, a.chunk_id AS chunk1_id, b.doc_id AS doc2, b.chunk_id AS chunk2_id
  FROM {seeds} s JOIN hit a ON a.canonical_name = s.seed JOIN hit b ON b.canonical_name = s.seed AND a.doc_id <> b.doc_id {order})
"""

BFS = """
reach AS (
  SELECT query_id, seed AS node, 0 AS d FROM {seeds} WHERE seed IN (SELECT canonical_name FROM entities)
  UNION SELECT r.query_id, e.dst, r.d + 1 FROM reach r JOIN {edges} e ON e.src = r.node WHERE r.d < {hops}),
nodes AS (
  SELECT query_id, node, entity_type, CAST(min(d) AS INTEGER) AS hop_distance FROM reach JOIN entities ON node = canonical_name GROUP BY query_id, node, entity_type)
"""

INDUCED = """
graph_edges AS (
  SELECT query_id, source, target, relation, description, weight FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, relation, target) AS n FROM (
      SELECT s.query_id, r.source, r.target, r.relation_type AS relation, min(r.description) AS description, min(r.weight) AS weight
      FROM {relations} r JOIN nodes s ON s.node = r.source JOIN nodes t ON t.node = r.target AND t.query_id = s.query_id GROUP BY ALL)) WHERE n <= 25)
"""


def _fused(graph: str, hits: str, bonus: str = "", limit: str = "WHERE rank <= 5") -> str:
    overlap = f"(SELECT count(DISTINCT node) FROM nodes WHERE nodes.query_id = b.query_id AND list_contains(string_split(mentioned_entities, ', '), node))" if bonus else "0"
    return f"""
ground AS ({graph}),
both_lists AS (
  SELECT coalesce(v.query_id, g.query_id) AS query_id, coalesce(v.chunk_id, g.chunk_id) AS chunk_id, v.rank AS v_rank, v.score AS vector_score, g.rank AS g_rank, g.graph_score, mentioned_entities
  FROM {hits} v FULL OUTER JOIN ground g ON v.query_id = g.query_id AND v.chunk_id = g.chunk_id),
scored AS (SELECT *, CAST({overlap} AS INTEGER) AS overlap, coalesce(0.55::DOUBLE * (1.0::DOUBLE / (60 + v_rank)), 0) + coalesce(0.45::DOUBLE * (1.0::DOUBLE / (60 + g_rank)), 0) AS fused FROM both_lists b),
final AS (SELECT *, round(fused * (1 + 0.15::DOUBLE * overlap), 8) AS fused_score FROM scored),
fused_all AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, v_rank NULLS LAST, g_rank NULLS LAST, chunk_id) AS INTEGER) AS rank FROM final),
fused AS (
  SELECT query_id, chunk_id, coalesce(vector_score, 0) AS vector_score, coalesce(graph_score, 0) AS graph_score, CAST(0.0 AS DOUBLE) AS keyword_score, fused_score, overlap, rank,
    'EntityMatch: ' || mentioned_entities AS graph_provenance FROM fused_all {limit})
"""


RETRIEVED = f"""
WITH RECURSIVE {EXTRACTED}, {QUESTIONS},
{BFS.format(seeds="seeds", edges="near_edges", hops=2)}, {INDUCED.format(relations="edges1")},
qhits AS (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COSINE.format("a.embedding", "b.embedding")} AS score
      FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT query_id FROM q) AND b.vec_id IN (SELECT chunk_id FROM reports))) WHERE rank <= 5),
{_fused(GROUNDED.format(seeds="seeds", mentions="mentions", score="count(*)"), "qhits", "yes")}
"""

_SHOWN = "(SELECT f.*, p.page_number, p.text, coalesce(nullif(p.filename, ''), CAST(p.doc_id AS VARCHAR)) AS doc FROM fused f JOIN reports p USING (chunk_id))"
_FACT = "CASE WHEN nullif(description, '') IS NOT NULL THEN source || ' (' || relation || ') -> ' || target || ' [' || description || ']' ELSE source || ' -' || relation || '-> ' || target END"

CONTEXT = """
SELECT query_id, '=== KNOWLEDGE GRAPH VERIFIED TRIPLETS (Ground Truth) ===' || chr(10)
  || string_agg('• (' || source || ') -[' || relation || ']-> (' || target || ')' || coalesce(': ' || nullif(description, ''), ''), chr(10) ORDER BY source, relation, target) AS context
FROM graph_edges GROUP BY query_id
"""

_LATENCY = """
SELECT {by} count(value) AS count, round(coalesce(quantile_cont(value, 0.5), 0), 2) AS p50_ms, round(coalesce(quantile_cont(value, 0.95), 0), 2) AS p95_ms, round(coalesce(quantile_cont(value, 0.99), 0), 2) AS p99_ms,
  round(coalesce(avg(value), 0), 2) AS mean_ms, CAST({budget} AS DOUBLE) AS sla_budget_ms,
  round(coalesce(CAST(count(*) FILTER (WHERE value <= {budget}) AS DOUBLE) / nullif(count(value), 0) * 100, 100.0), 2) AS sla_compliance_pct
FROM events {rest}
"""

SPANS = r"""
tags AS (SELECT page_id, unnest(t) AS tag, unnest(x) AS text, generate_subscripts(t, 1) - 1 AS k FROM (
  SELECT page_id, regexp_extract_all(html, '<([a-z0-9]+)[^<>]*>([^<>]+)', 1) AS t, regexp_extract_all(html, '<([a-z0-9]+)[^<>]*>([^<>]+)', 2) AS x FROM pages)),
w AS (SELECT page_id, tag, k, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS n FROM (SELECT page_id, tag, k, string_split(text, ' ') AS s FROM tags)),
spans AS (
  SELECT page_id, CAST(k AS INTEGER) AS block_no, n // 8 AS line_no, n % 8 AS span_no, CAST((k * 37) % 50 AS DOUBLE) AS x, CAST((k * 53) % 97 AS DOUBLE) AS y,
    CAST(CASE WHEN tag = 'h1' THEN 24 WHEN tag = 'h2' OR (n + k) % 11 = 0 THEN 16 ELSE 10 END AS DOUBLE) AS size, text || ' ' AS text FROM w),
sized AS (SELECT *, coalesce(avg(CASE WHEN trim(text) <> '' THEN size END) OVER (PARTITION BY page_id), 11.0) AS avg_size FROM spans),
lines0 AS (
  SELECT page_id, block_no, line_no, min(x) AS x, min(y) AS y, max(CASE WHEN size > 1.3 * avg_size THEN [line_no, span_no, CASE WHEN size > 1.6 * avg_size THEN 1 ELSE 2 END] END) AS head,
    regexp_replace(string_agg(text, '' ORDER BY span_no), '^\s+|\s+$', '', 'g') AS line FROM sized GROUP BY page_id, block_no, line_no),
blocks0 AS (
  SELECT page_id, block_no, min(x) AS x, min(y) AS y, max(head) IS NOT NULL AS is_heading, CAST(coalesce(max(head)[3], 0) AS INTEGER) AS heading_level,
    string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE line <> '') AS body FROM lines0 GROUP BY page_id, block_no),
blocks AS (SELECT page_id, block_no, x, y, is_heading, heading_level, CASE WHEN heading_level > 0 THEN repeat('#', heading_level) || ' ' ELSE '' END || body AS text FROM blocks0 WHERE body IS NOT NULL)
"""

_MENTIONS_OF = "WITH " + EXTRACTED + " SELECT chunk_id, canonical_name, name, entity_type, confidence FROM mentions WHERE entity_type = "

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BM25 = f"""
dterms AS (SELECT doc_id, {_TERMS} AS t FROM documents),
dstats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dterms),
tf AS (SELECT doc_id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dterms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qterms AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark),
bm25 AS (
  SELECT query_id, doc_id AS chunk_id,
    round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score
  FROM qterms JOIN tf USING (term) JOIN df USING (term), dstats GROUP BY ALL),
khits AS (SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25))
"""

_INCREMENTS = rf"""
WITH RECURSIVE {REPORTS},
now AS (SELECT * REPLACE (CASE WHEN page_number % 3 = 1 THEN text ELSE regexp_replace(text, '#+ [^\n]*', '', 'g') END AS text) FROM reports),
{LINES.format("now")}, {HEADINGS}, {FOLD.format(size=384, overlap=64)}
"""
_INCREMENTS_FOUND = f"{_INCREMENTS}, {extraction('(SELECT doc_id * 1000 + page_number AS chunk_id, doc_id, text FROM chunks)')}"


ORACLE_SQL: dict[str, str] = {
    "vector_topk_batch": f"WITH {VECTORS} SELECT * FROM hits",
    "vector_store_topk": f"WITH {VECTORS} SELECT * FROM hits",
    "vector_topk_payload": f"WITH {VECTORS} SELECT query_id, rank, vec_id AS chunk_id, score, length(text) AS text_chars, md5(text) AS text_md5 FROM hits JOIN documents ON vec_id = doc_id",
    "vector_missing_payload": f"WITH {VECTORS} SELECT query_id, rank, vec_id AS chunk_id, score, coalesce(left(url, 1000), '') AS text FROM hits LEFT JOIN pages ON vec_id = page_id",
    "vector_upsert_last_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "query_cache_key": "SELECT sha256(lower(trim(text))) AS cache_key, count(*) AS n_asked FROM conversations WHERE role = 'user' GROUP BY 1",
    "query_cache_replay": """WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(sha256(lower(trim(text))), '') AS cache_key FROM conversations WHERE role = 'user'),
log AS (SELECT *, row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, cache_key) AS n FROM keyed),
walk AS (
  SELECT capacity, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS BOOLEAN) AS hit, CAST(NULL AS VARCHAR) AS evicted_key FROM (VALUES (16), (128), (10000)) c(capacity)
  UNION ALL
  SELECT capacity, l.n, CASE WHEN list_contains(held, cache_key) THEN held WHEN len(held) >= capacity THEN list_append(held[2:], cache_key) ELSE list_append(held, cache_key) END,
    list_contains(held, cache_key), CASE WHEN NOT list_contains(held, cache_key) AND len(held) >= capacity THEN held[1] END
  FROM walk w JOIN log l ON l.n = w.n + 1)
SELECT capacity, conv_id, turn, cache_key, hit, evicted_key FROM walk JOIN log USING (n)""",
    "call_ledger": """SELECT sha256('stand-in' || chr(10) || text) AS key, 'answered' AS state, length(text) || ' characters, ending in ' || right(text, 12) AS answer,
  CASE WHEN bool_or(conv_id % 2 = 0) THEN 1 ELSE 2 END AS run, count(*) AS n_asked
FROM conversations WHERE text IS NOT NULL GROUP BY text""",
    "doc_lines": f"WITH {LINES.format(_DOC_PAGES)} SELECT doc_id, line_no, n_words, md5(line) AS line_md5 FROM lines",
    "heading_state": f"WITH {REPORTS}, {LINES.format('reports')}, {HEADINGS} SELECT doc_id, page_number, line_no, coalesce(h2, h1, 'General') AS section_title, concat_ws(' / ', h1, h2) AS section_path FROM headed",
    "chunk_fold": f"WITH RECURSIVE {LINES.format(_DOC_PAGES)}, {HEADINGS}, {FOLD.format(size=384, overlap=64)} SELECT doc_id, chunk_no, start_word, token_count FROM ranges",
    "chunk_text": f"WITH RECURSIVE {LINES.format(_DOC_PAGES)}, {HEADINGS}, {FOLD.format(size=384, overlap=64)} SELECT doc_id, chunk_no, token_count, section_title, md5(text) AS text_md5 FROM chunks",
    "chunk_sections": f"WITH RECURSIVE {REPORTS}, {LINES.format('reports')}, {HEADINGS}, {FOLD.format(size=16, overlap=4)} SELECT doc_id, page_number, chunk_no, token_count, section_title, text FROM chunks",
    "chunk_links": "SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "chunk_context": "SELECT conv_id, turn, text, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "extract_org": _MENTIONS_OF + "'ORGANIZATION'",
    "extract_tech": _MENTIONS_OF + "'TECHNOLOGY'",
    "extract_metric": _MENTIONS_OF + "'METRIC'",
    "canonicalize": f"""
SELECT p_partkey, {canonical("raw")} AS canonical_name, {canonical("ali")} AS alias_name FROM (
  SELECT p_partkey, ' (' || upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || '  ' || p_brand || [' Inc', ' Corp.', ' LLC.', ' Ltd', ' Co.', '.', '!?', ''][p_partkey % 8 + 1] || ' ' AS raw,
    [' google ', 'Apple', 'NVIDIA', 'meta.', 'other'][p_partkey % 5 + 1] AS ali FROM part)""",
    "relation_triggers": f"WITH {EXTRACTED} SELECT chunk_id, source, target, relation_type, position, description, weight, confidence FROM relations",
    "entity_merge": f"WITH {EXTRACTED} SELECT canonical_name, entity_type, confidence, n_chunks, n_docs, first_chunk FROM entities",
    "entity_sources": f"WITH {EXTRACTED} SELECT DISTINCT canonical_name, 'chunk' AS source, chunk_id AS id FROM mentions UNION ALL SELECT DISTINCT canonical_name, 'doc', doc_id FROM mentions",
    "relation_merge": f"WITH {EXTRACTED} SELECT * FROM edges1",
    "gazetteer_hits": f"WITH {EXTRACTED} SELECT reports.chunk_id, canonical_name, CAST(strpos(text, canonical_name) AS BIGINT) AS first_at FROM reports JOIN entities ON contains(text, canonical_name) WHERE canonical_name <> ''",
    "fulltext_topk": f"WITH {BM25} SELECT query_id, rank, chunk_id, score FROM khits WHERE rank <= 10",
    "rrf_three_lists": f"""WITH {LEXICON}, {BM25},
ground AS ({GROUNDED.format(seeds="bench", mentions="lex", score="count(*)")}),
vhits AS (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COSINE.format("a.embedding", "b.embedding")} AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 5),
two AS (
  SELECT coalesce(v.query_id, g.query_id) AS query_id, coalesce(v.chunk_id, g.chunk_id) AS chunk_id, v.rank AS v_rank, v.score AS vector_score, g.rank AS g_rank, g.graph_score
  FROM vhits v FULL OUTER JOIN ground g ON v.query_id = g.query_id AND v.chunk_id = g.chunk_id),
three AS (
  SELECT coalesce(two.query_id, k.query_id) AS query_id, coalesce(two.chunk_id, k.chunk_id) AS chunk_id, v_rank, vector_score, g_rank, graph_score, k.rank AS k_rank, k.score AS keyword_score
  FROM two FULL OUTER JOIN (SELECT * FROM khits WHERE rank <= 5) k ON two.query_id = k.query_id AND two.chunk_id = k.chunk_id),
summed AS (
  SELECT *, round(coalesce(0.55::DOUBLE * (1.0::DOUBLE / (60 + v_rank)), 0) + coalesce(0.45::DOUBLE * (1.0::DOUBLE / (60 + g_rank)), 0) + coalesce(0.45::DOUBLE * (1.0::DOUBLE / (60 + k_rank)), 0), 8) AS fused_score FROM three)
SELECT query_id, chunk_id, coalesce(vector_score, 0) AS vector_score, coalesce(graph_score, 0) AS graph_score, coalesce(keyword_score, 0) AS keyword_score, fused_score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, v_rank NULLS LAST, g_rank NULLS LAST, k_rank NULLS LAST, chunk_id) AS INTEGER) AS rank FROM summed""",
    "chunk_increments": f"""{_INCREMENTS}
SELECT c.doc_id, c.page_number, c.chunk_no, c.token_count, c.section_title, concat_ws(' / ', h1, h2) AS section_path, 'report_' || c.doc_id || '.pdf' AS filename, c.text, true AS id_of_place,
  row_number() OVER (PARTITION BY c.doc_id ORDER BY c.page_number, c.chunk_no) = 1 AS is_first
FROM chunks c JOIN ranges r ON r.doc_id = c.doc_id AND r.page_number = c.page_number AND r.chunk_no = c.chunk_no
JOIN headed h ON h.doc_id = c.doc_id AND h.page_number = c.page_number AND h.line_no = r.last_line""",
    "store_entities": f"{_INCREMENTS_FOUND} SELECT canonical_name, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM mentions GROUP BY canonical_name",
    "store_relations": f"{_INCREMENTS_FOUND} SELECT DISTINCT source, target, relation_type, description, weight, confidence FROM relations",
    "query_seeds_fallback": f"WITH {LEXICON} SELECT * FROM bench",
    "grounded_chunks": f"WITH {LEXICON} {GROUNDED.format(seeds='bench', mentions='lex', score='count(*)')}",
    "grounded_chunks_conf": f"WITH {EXTRACTED}, {QUESTIONS} {GROUNDED.format(seeds='seeds', mentions='mentions', score='sum(coalesce(confidence, 1.0))')}",
    "multi_doc_bridges": f"""WITH {LEXICON}, {BRIDGES.format(mentions="lex", seeds="bench", order="AND a.chunk_id < b.chunk_id")}
SELECT query_id, CAST(nth AS INTEGER) AS nth, shared_entity, doc1, chunk1_id, left(x.text, 200) AS chunk1_text, doc2, chunk2_id, left(y.text, 200) AS chunk2_text
FROM ranked LEFT JOIN documents x ON x.doc_id = chunk1_id LEFT JOIN documents y ON y.doc_id = chunk2_id WHERE nth <= 5""",
    "neighbors_1hop": f"""WITH {TRADE},
s AS (SELECT s_suppkey AS query_id, s_name AS seed FROM supplier),
m AS (SELECT query_id, canonical_name FROM s JOIN entities ON seed = canonical_name UNION SELECT query_id, canonical_name FROM s JOIN entities ON seed = name),
r AS (SELECT source AS a, target AS b, relation_type, description, weight FROM relations UNION ALL SELECT target, source, relation_type, description, weight FROM relations)
SELECT query_id, m.canonical_name AS source, relation_type, description, weight, b AS target, e.entity_type AS target_type FROM m LEFT JOIN (r JOIN entities e ON e.canonical_name = b) ON a = m.canonical_name""",
    "neighbors_limited": f"""WITH {TRADE},
s AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, n_name AS seed FROM nation),
m AS (SELECT query_id, canonical_name FROM s JOIN entities ON seed = name),
r AS (SELECT source AS a, target AS b, relation_type, description, weight FROM relations UNION ALL SELECT target, source, relation_type, description, weight FROM relations)
SELECT query_id, m.canonical_name AS source, relation_type, description, weight, b AS target, e.entity_type AS target_type FROM m LEFT JOIN (r JOIN entities e ON e.canonical_name = b) ON a = m.canonical_name
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m.canonical_name, relation_type, b, description) <= 10""",
    "subgraph_limited": f"""WITH {TRADE},
s AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'nation:' || n_nationkey AS seed FROM nation),
near AS (SELECT query_id, seed AS node FROM s UNION SELECT query_id, dst FROM s JOIN both_ways ON src = seed),
d AS (
  SELECT DISTINCT query_id, source, relation_type AS relation, description, weight, target, entity_type AS target_type FROM near JOIN relations ON node IN (source, target) JOIN entities ON canonical_name = target)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY source, relation, target, description) <= 25""",
    "subgraph_2hop": f"""WITH {TRADE},
near AS (SELECT query_id, seed AS node FROM seeds UNION SELECT query_id, dst FROM seeds JOIN both_ways ON src = seed)
SELECT DISTINCT query_id, source, relation_type AS relation, description, weight, target, entity_type AS target_type
FROM near JOIN relations ON node IN (source, target) JOIN entities ON canonical_name = target""",
    "bfs_nodes": f"WITH RECURSIVE {TRADE}, {BFS.format(seeds='seeds', edges='both_ways', hops=2)} SELECT * FROM nodes",
    "bfs_edges": f"WITH RECURSIVE {TRADE}, {BFS.format(seeds='seeds', edges='both_ways', hops=2)}, {INDUCED.format(relations='relations')} SELECT * FROM graph_edges",
    "bfs_mentions": f"WITH RECURSIVE {EXTRACTED}, {QUESTIONS}, {BFS.format(seeds='seeds', edges='mention_edges', hops=2)} SELECT * FROM nodes",
    "bfs_whole_graph": f"""WITH RECURSIVE {EXTRACTED},
rseeds AS (SELECT CAST(r_regionkey AS BIGINT) AS query_id, 'Cust' || {_LETTERS.format("(r_regionkey * 5 + 1)")} || ' Corp.' AS seed FROM region),
nxt AS (SELECT 'chunk:' || chunk_id AS src, 'chunk:' || lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY page_number) AS dst FROM reports),
links AS (SELECT * FROM nxt WHERE dst IS NOT NULL UNION ALL SELECT 'doc:' || doc_id, 'chunk:' || chunk_id FROM reports),
every_edge AS (SELECT * FROM near_edges UNION SELECT * FROM links UNION SELECT dst, src FROM links),
{BFS.format(seeds="rseeds", edges="every_edge", hops=3)} SELECT * FROM nodes""",
    "shortest_path": f"""WITH RECURSIVE {TRADE},
walk AS (
  SELECT seed AS start, seed AS node, seed AS path, 0 AS d FROM seeds
  UNION ALL SELECT start, dst, path || ' > ' || dst, d + 1 FROM walk JOIN both_ways ON src = node WHERE d < 4 AND NOT contains(path || ' > ', ' > ' || dst || ' > ') AND dst <> start)
SELECT start, "end", hop_length, path FROM (
  SELECT start, node AS "end", CAST(d AS INTEGER) AS hop_length, path, row_number() OVER (PARTITION BY start, node ORDER BY d, path) AS n FROM walk WHERE node LIKE 'customer:%') WHERE n = 1""",
    "dangling_entities": f"""WITH {TRADE}
SELECT c AS canonical_name, c AS name, 'CONCEPT' AS entity_type FROM (SELECT source AS c FROM relations UNION SELECT target FROM relations)
WHERE c NOT IN (SELECT canonical_name FROM entities WHERE entity_type <> 'NATION')""",
    "mention_guard": f"WITH {LEXICON} SELECT doc_id, count(*) AS n_mentions FROM lex WHERE chunk_id IN (SELECT doc_id FROM labels) GROUP BY doc_id",
    "graph_edges": f"""WITH {EXTRACTED},
e AS (
  SELECT 'doc:' || doc_id AS src, 'chunk:' || chunk_id AS dst, 'CONTAINS_CHUNK' AS rel_type, NULL AS explicit_rel, page_number AS page FROM reports
  UNION ALL SELECT * FROM (SELECT 'chunk:' || chunk_id, 'chunk:' || lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY page_number) AS nxt, 'NEXT_CHUNK', NULL, NULL FROM reports) WHERE nxt IS NOT NULL
  UNION ALL SELECT 'chunk:' || chunk_id, 'entity:' || canonical_name, 'MENTIONS', NULL, NULL FROM mentions
  UNION ALL SELECT 'entity:' || source, 'entity:' || target, 'RELATION', relation_type, NULL FROM relations)
SELECT rel_type, explicit_rel, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst, CAST(sum(page) AS BIGINT) AS pages FROM e GROUP BY ALL""",
    "rrf_fuse": f"""WITH {LEXICON}, {VECTORS},
d0 AS (SELECT doc_id, {CAPITALS.format("text")} AS s FROM documents WHERE doc_id % 50 = 0),
dseeds AS (SELECT doc_id AS query_id, CAST(i - 1 AS INTEGER) AS ord, s[i] AS seed FROM d0, unnest(range(1, len(s) + 1)) r(i) WHERE s[i] <> ''),
vhits AS (SELECT query_id, rank, vec_id AS chunk_id, score FROM hits WHERE query_id IN (SELECT doc_id FROM d0 WHERE len(s) > 0)),
{_fused(GROUNDED.format(seeds="dseeds", mentions="lex", score="count(*)"), "vhits", limit="")}
SELECT query_id, chunk_id, vector_score, graph_score, keyword_score, fused_score, rank FROM fused""",
    "rrf_centrality": f"{RETRIEVED} SELECT * FROM fused",
    "triples_context": f"WITH RECURSIVE {TRADE}, {BFS.format(seeds='seeds', edges='both_ways', hops=2)}, {INDUCED.format(relations='relations')} {CONTEXT}",
    "multi_hop_paths": f"""WITH RECURSIVE {TRADE}, {BFS.format(seeds="seeds", edges="both_ways", hops=2)}, {INDUCED.format(relations="relations")}
SELECT query_id, string_agg(source || ' | ' || relation || ' | ' || target, chr(10) ORDER BY source, relation, target) AS paths FROM graph_edges GROUP BY query_id""",
    "provenance_docs": f"{RETRIEVED} SELECT query_id, string_agg(DISTINCT doc, ', ' ORDER BY doc) AS provenance_documents FROM {_SHOWN} GROUP BY query_id",
    "answer_batch": f"""{RETRIEVED},
facts AS (SELECT query_id, list({_FACT} ORDER BY source, relation, target) AS f FROM graph_edges GROUP BY query_id),
cited AS (
  SELECT query_id, list('  [' || rank || '] (Source: ' || doc || ', p.' || page_number || ') ' || left({_trim("text")}, 250) || '...' ORDER BY rank) AS x,
    string_agg(DISTINCT doc || ' (Page ' || page_number || ')', ', ' ORDER BY doc || ' (Page ' || page_number || ')') FILTER (WHERE rank <= 3) AS sources FROM {_SHOWN} GROUP BY query_id)
SELECT query_id, CASE WHEN f IS NULL AND x IS NULL THEN 'No relevant information found in the knowledge base.' ELSE concat_ws(chr(10),
  'Based on hybrid multi-document retrieval for ''' || question || ''':' || chr(10),
  'Key Entity & Relational Insights:' || chr(10) || array_to_string(list_transform(f[1:8], lambda e: '  • ' || e), chr(10)) || chr(10),
  'Supporting Evidence:' || chr(10) || array_to_string(x[1:3], chr(10)) || chr(10), 'Sources: ' || coalesce(sources, '')) END AS response,
  CAST(coalesce(len(x), 0) AS BIGINT) AS n_chunks, CAST(coalesce(len(f), 0) AS INTEGER) AS n_edges, provenance_documents, paths
FROM q LEFT JOIN facts USING (query_id) LEFT JOIN cited USING (query_id)
LEFT JOIN (SELECT query_id, string_agg(DISTINCT doc, ', ' ORDER BY doc) AS provenance_documents FROM {_SHOWN} GROUP BY query_id) USING (query_id)
LEFT JOIN (SELECT query_id, string_agg(source || ' | ' || relation || ' | ' || target, chr(10) ORDER BY source, relation, target) AS paths FROM graph_edges GROUP BY query_id) USING (query_id)""",
    "scored_nodes": f"""{RETRIEVED}
SELECT query_id, rank, CAST(chunk_id AS VARCHAR) AS id, md5(text) AS text_md5, fused_score AS score, filename, CAST(page_number AS VARCHAR) AS page_number, 'General' AS section_title, vector_score, graph_score
FROM fused JOIN reports USING (chunk_id)""",
    "llm_prompts": f"""{RETRIEVED}, ctx AS ({CONTEXT}),
docs AS (SELECT query_id, string_agg('Chunk ' || rank || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS docs FROM {_SHOWN} GROUP BY query_id)
SELECT query_id, length(p) AS prompt_chars, md5(p) AS prompt_md5 FROM (
  SELECT query_id, 'Answer the user query based strictly on the verified knowledge graph and documents.' || chr(10) || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'DOCUMENT CONTEXT:' || chr(10)
    || coalesce(docs, '') || chr(10) || chr(10) || 'Query: ' || question || chr(10) || 'Answer:' AS p FROM q LEFT JOIN ctx USING (query_id) LEFT JOIN docs USING (query_id))""",
    "latency_percentiles": _LATENCY.format(by="event_type,", budget="40.0", rest="GROUP BY event_type"),
    "latency_hours": _LATENCY.format(by="event_type,", budget="40.0", rest="WHERE day(ts) % 2 = 1 GROUP BY event_type"),
    "latency_empty": _LATENCY.format(by="", budget="400.0", rest="WHERE event_type = 'no such type'"),
    "sla_compliance": "SELECT user_id, count(*) FILTER (WHERE value <= 40) AS n_compliant, count(*) FILTER (WHERE value > 40) AS n_exceeding FROM events GROUP BY user_id",
    "stage_breakdown": "SELECT "
    + ", ".join(
        f"round(coalesce(avg(value) FILTER (WHERE event_id % 6 = {n}), 0), 2) AS {s}"
        for n, s in enumerate(("entity_extraction_ms", "embedding_ms", "vector_search_ms", "graph_traversal_ms", "rrf_fusion_ms", "generation_ms"))
    )
    + " FROM events",
    "latency_table": f"""
SELECT event_type, format('{{}} queries: mean {{:.2f}} ms, p50 {{:.2f}} ms, p95 {{:.2f}} ms, p99 {{:.2f}} ms, {{:.2f}}% within {{:.1f}} ms', count, mean_ms, p50_ms, p95_ms, p99_ms, sla_compliance_pct, sla_budget_ms) AS summary
FROM ({_LATENCY.format(by="event_type,", budget="40.0", rest="GROUP BY event_type")})""",
    "ingest_stats": f"""WITH RECURSIVE {EXTRACTED}, {LINES.format("reports")}, {HEADINGS}, {FOLD.format(size=384, overlap=64)}
SELECT count(DISTINCT doc_id) AS total_documents, count(*) AS total_pages, (SELECT count(*) FROM ranges) AS total_chunks, (SELECT count(*) FROM entities) AS total_entities,
  (SELECT count(*) FROM relations) AS total_relationships, count(*) FILTER (WHERE length(text) < 150) AS ocr_pages_count, CAST(12.5 AS DOUBLE) AS elapsed_seconds,
  round(CAST(count(*) AS DOUBLE) / 12.5 * 3600, 1) AS pages_per_hour, round(CAST(count(*) AS DOUBLE) / 12.5, 2) AS pages_per_second FROM reports""",
    "heading_level": f"WITH {SPANS} SELECT * FROM blocks",
    "layout_blocks_order": f"WITH {SPANS} SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY round_even(y / 10, 0) * 10, x, block_no) AS text FROM blocks GROUP BY page_id",
    "ocr_select": """
SELECT doc_id, length(t) AS text_chars, md5(t) AS text_md5 FROM (
  SELECT a.doc_id, CASE WHEN length(trim(coalesce(a.text, ''))) < 50 AND length(trim(b.text)) > length(trim(coalesce(a.text, ''))) THEN b.text ELSE a.text END AS t
  FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1)""",
    "metadata_defaults": f"""WITH {REPORTS}
SELECT doc_id, coalesce(nullif(min(title), ''), min(filename)) AS title, left(coalesce(nullif(min(title), ''), 'General'), 12) AS section FROM reports GROUP BY doc_id""",
    "synthetic_corpus": f"WITH {REPORTS} SELECT * FROM reports",
    # with an entity in two documents every chunk has a partner, so the first pairs start at its first chunks
    "multi_doc_bridges_ordered": f"""WITH {EXTRACTED}, {QUESTIONS},
hit AS (SELECT DISTINCT chunk_id, doc_id, canonical_name FROM mentions WHERE canonical_name IN (SELECT seed FROM seeds)),
several AS (SELECT canonical_name FROM hit GROUP BY canonical_name HAVING count(DISTINCT doc_id) > 1),
starts AS (SELECT * FROM hit WHERE canonical_name IN (SELECT canonical_name FROM several) QUALIFY row_number() OVER (PARTITION BY canonical_name ORDER BY chunk_id) <= 5),
ranked AS (
  SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.ord, a.chunk_id, b.chunk_id) AS nth, s.seed AS shared_entity,
    a.doc_id AS doc1, a.chunk_id AS chunk1_id, b.doc_id AS doc2, b.chunk_id AS chunk2_id
  FROM seeds s JOIN starts a ON a.canonical_name = s.seed JOIN hit b ON b.canonical_name = s.seed AND a.doc_id <> b.doc_id),
titles AS (SELECT doc_id, nullif(min(title), '') AS title FROM reports GROUP BY doc_id)
SELECT query_id, CAST(nth AS INTEGER) AS nth, shared_entity, doc1, chunk1_id, doc2, chunk2_id, t1.title AS title1, t2.title AS title2
FROM ranked JOIN titles t1 ON t1.doc_id = doc1 JOIN titles t2 ON t2.doc_id = doc2 WHERE nth <= 5""",
}
