"""The registered queries as SQL for the driver's comparison (DuckDB)."""

from __future__ import annotations

#: Fixed value: the Unicode White_Space characters, as SQL.
WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(133)||chr(160)||chr(5760)||" + "||".join(f"chr({c})" for c in range(8192, 8203)) + "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"

CURRENT = "SELECT doc_id, 'documents/' || doc_id || '.txt' AS source, doc_id || '.txt' AS doc_name, sha256(text) AS file_hash FROM documents"
STORED = f"SELECT source, doc_name, '2022-01-08' AS created, '2022-01-08' AS updated, CASE WHEN doc_id % 7 = 0 THEN 'deadbeef' ELSE file_hash END AS file_hash FROM ({CURRENT}) WHERE doc_id % 5 <> 0"

#: chunks(doc_id, chunk_id, chunk_text): size 1000, overlap 150, least 200.
CHUNKS = f"""
t AS (SELECT doc_id, trim(text, {WS}) AS s FROM documents),
step(doc_id, s, n, i, pos, cut) AS (
  SELECT doc_id, s, length(s), 0, CAST(0 AS BIGINT), {{cut0}} FROM t WHERE s <> ''
  UNION ALL
  SELECT doc_id, s, n, i + 1, p, {{cutp}}
  FROM (SELECT doc_id, s, n, i, CASE WHEN greatest(cut - 150, 0) > pos THEN greatest(cut - 150, 0) ELSE cut END AS p FROM step WHERE cut < n)
),
raw AS (SELECT doc_id, i, trim(substr(s, pos + 1, cut - pos), {WS}) AS x FROM step),
numbered AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS f FROM raw WHERE x <> ''),
grouped AS (SELECT doc_id, x, f, sum(CASE WHEN f = 1 OR length(x) >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY f) - 1 AS chunk_id FROM numbered),
chunks AS (SELECT doc_id, CAST(chunk_id AS BIGINT) AS chunk_id, string_agg(x, chr(10) || chr(10) ORDER BY f) AS chunk_text FROM grouped GROUP BY doc_id, chunk_id)"""


def _cut(s: str, n: str, p: str) -> str:
    win = f"substr({s}, {p} + 1, 1000)"
    marks = ("(?s)^(.*[。！？])", "(?s)^(.*\n\n)", "(?s)^(.*\n)")
    tiers = ", ".join(f"nullif(length(regexp_extract({win}, '{m}', 1)), 0)" for m in marks)
    return f"CAST(CASE WHEN {n} - {p} <= 1000 THEN {n} ELSE {p} + coalesce({tiers}, 1000) END AS BIGINT)"


CHUNKS = CHUNKS.format(cut0=_cut("s", "length(s)", "0"), cutp=_cut("s", "n", "p"))

TERM = "nder the tion"


def _search(queries: str, limit: int = 5) -> str:
    """CTEs up to ``fused`` (query_id, source, chunk_id, score, method, rank)."""
    grams = "unnest(list_transform(range(1, length({0})::BIGINT), lambda i: substr(lower({0}), i, 2)))"
    slot = "('0x' || substr(md5(g), 1, 2))::INT % 64"
    return f"""{CHUNKS},
c AS (SELECT 'documents/' || doc_id || '.txt' AS source, chunk_id, chunk_text FROM chunks),
q AS ({queries}),
cg AS (SELECT source, chunk_id, g, count(*) AS tf FROM (SELECT source, chunk_id, {grams.format("chunk_text")} AS g FROM c) GROUP BY ALL),
qg AS (SELECT query_id, g, count(*) AS tf FROM (SELECT query_id, {grams.format("query")} AS g FROM q) GROUP BY ALL),
len AS (SELECT source, chunk_id, greatest(length(chunk_text) - 1, 0) AS dl FROM c),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
idf AS (SELECT g, ln(1 + ((SELECT n FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM cg WHERE g IN (SELECT g FROM qg) GROUP BY g),
bm AS (
  SELECT query_id, source, chunk_id, round(sum(idf * cg.tf * 2.2 / (cg.tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avgdl FROM corpus)))), 9) AS score
  FROM qg JOIN q USING (query_id) JOIN cg USING (g) JOIN idf USING (g) JOIN len USING (source, chunk_id) WHERE length(query) >= 2 GROUP BY ALL
),
fts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_id) - 1 AS rank FROM bm QUALIFY rank < {limit}),
cv AS (SELECT source, chunk_id, {slot} AS d, sum(tf)::DOUBLE AS x FROM cg GROUP BY ALL),
qv AS (SELECT query_id, {slot} AS d, sum(tf)::DOUBLE AS x FROM qg GROUP BY ALL),
cn AS (SELECT source, chunk_id, sqrt(sum(x * x)) AS norm FROM cv GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(x * x)) AS norm FROM qv GROUP BY ALL),
dots AS (SELECT query_id, source, chunk_id, sum(cv.x * qv.x) AS dot FROM qv JOIN cv USING (d) GROUP BY ALL),
pairs AS (
  SELECT q.query_id, c.source, c.chunk_id, round(-sqrt(greatest(
    (CASE WHEN qn.norm IS NULL THEN 0 ELSE 1 END) + (CASE WHEN cn.norm IS NULL THEN 0 ELSE 1 END) - 2 * coalesce(dot / (qn.norm * cn.norm), 0), 0)), 9) AS score
  FROM q CROSS JOIN c LEFT JOIN qn USING (query_id) LEFT JOIN cn USING (source, chunk_id) LEFT JOIN dots USING (query_id, source, chunk_id)
),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_id) - 1 AS rank FROM pairs QUALIFY rank < {limit}),
both_legs AS (SELECT query_id, source, chunk_id, 1.0::DOUBLE / (60 + rank + 1) AS part, 1 AS leg FROM fts UNION ALL SELECT query_id, source, chunk_id, 1.0::DOUBLE / (60 + rank + 1), 2 FROM vec),
summed AS (SELECT query_id, source, chunk_id, sum(part) AS score, CASE bit_or(leg) WHEN 3 THEN 'Hybrid' WHEN 1 THEN 'Keyword' ELSE 'Semantic' END AS method FROM both_legs GROUP BY query_id, source, chunk_id),
fused AS (SELECT query_id, source, chunk_id, round(score, 9) AS score, method, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_id) - 1 AS rank FROM summed QUALIFY rank < {limit})"""


ONE = f"SELECT CAST(0 AS BIGINT) AS query_id, '{TERM}' AS query"

#: Sections of the pages' layout: what stands before the heading, and the heading with what follows.
_PAGE = """
b AS (SELECT page_id, regexp_replace(replace(regexp_replace(html, '(?s)<head>.*?</head>', ''), '<br><p>', '<br></p><p>'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
p AS (
  SELECT page_id, 0 AS part, '' AS heading, split_part(h, '<h1>', 1) AS x FROM b
  UNION ALL SELECT page_id, 1, regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1), split_part(h, '</h1>', 2) FROM b
),
u AS (SELECT page_id, part, {heading} AS heading, {body} AS body FROM p),
sections AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part) - 1 AS section, heading, body FROM u WHERE body <> '')"""


def _shown(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '</?(p|li|nav|article|footer|div)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for name, code in (("lt", 60), ("gt", 62), ("quot", 34), ("copy", 169), ("middot", 183), ("amp", 38)):
        out = f"replace({out}, '&{name};', chr({code}))"
    return f"trim(regexp_replace(regexp_replace({out}, '[\\t\\r\\f\\v \\x{{A0}}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})"


PAGE_SECTIONS = _PAGE.format(heading=_shown("heading"), body=_shown("x"))
PAGE_CHUNKS = CHUNKS.replace("SELECT doc_id, trim(text", "SELECT page_id * 10 + section AS doc_id, trim(body").replace("FROM documents", "FROM sections")

DELIMITED = """
WITH RECURSIVE l AS (
  SELECT CAST(c_custkey // 500 * 100 + c_nationkey AS BIGINT) AS file, 'key: ' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ', segment: ' || c_mktsegment END || ', name: ' || c_name || '{delimiter} "x"' AS line,
    row_number() OVER (PARTITION BY c_custkey // 500 * 100 + c_nationkey ORDER BY c_custkey) AS i FROM customer
), f(file, i, chunk_id, size) AS (
  SELECT file, i, CAST(0 AS BIGINT), length(line) FROM l WHERE i = 1
  UNION ALL
  SELECT l.file, l.i, CASE WHEN f.size + 1 + length(l.line) <= 200 THEN f.chunk_id ELSE f.chunk_id + 1 END, CASE WHEN f.size + 1 + length(l.line) <= 200 THEN f.size + 1 + length(l.line) ELSE length(l.line) END
  FROM f JOIN l ON l.file = f.file AND l.i = f.i + 1
)
SELECT file, chunk_id, string_agg(line, chr(10) ORDER BY i) AS chunk_text FROM f JOIN l USING (file, i) GROUP BY ALL"""

#: As _search, but for vectors that are stored as floats.
FLOATS = """
cf AS (SELECT source, chunk_id, d, CAST(x / norm AS FLOAT)::DOUBLE AS x FROM cv JOIN cn USING (source, chunk_id)),
qf AS (SELECT query_id, d, CAST(x / norm AS FLOAT)::DOUBLE AS x FROM qv JOIN qn USING (query_id)),
cs AS (SELECT source, chunk_id, sum(x * x) AS s FROM cf GROUP BY ALL),
qs AS (SELECT query_id, sum(x * x) AS s FROM qf GROUP BY ALL),
dots AS (SELECT query_id, source, chunk_id, sum(cf.x * qf.x) AS dot FROM qf JOIN cf USING (d) GROUP BY ALL),
pairs AS (
  SELECT q.query_id, c.source, c.chunk_id, round(-sqrt(greatest(coalesce(qs.s, 0) + coalesce(cs.s, 0) - 2 * coalesce(dot, 0), 0)), 9) AS score
  FROM q CROSS JOIN c LEFT JOIN qs USING (query_id) LEFT JOIN cs USING (source, chunk_id) LEFT JOIN dots USING (query_id, source, chunk_id)
),
"""


def _floats(sql: str) -> str:
    """The search's CTEs with ``dots`` and ``pairs`` over floats."""
    start, end = sql.index("dots AS ("), sql.index("vec AS (")
    return sql[:start] + FLOATS.strip() + "\n" + sql[end:]


NEAREST = """
WITH p AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(sqrt(greatest(list_dot_product(q.e, q.e) + list_dot_product(v.e, v.e) - 2 * list_dot_product(q.e, v.e), 0)), 9) AS d
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v
)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) - 1 AS rank FROM p QUALIFY rank < 5"""

ORACLE_SQL: dict[str, str] = {
    "html_sections": f"WITH {PAGE_SECTIONS} SELECT page_id, CAST(section AS BIGINT) AS section, heading, body FROM sections",
    "html_chunks": f"""
WITH RECURSIVE {PAGE_SECTIONS}, {PAGE_CHUNKS}
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY section, chunk_id) - 1 AS chunk_id, CASE WHEN heading = '' THEN '' ELSE heading || chr(10) END || chunk_text AS chunk_text
FROM chunks JOIN sections ON doc_id = page_id * 10 + section""",
    "doc_meta_build": f"SELECT source, doc_name, '2022-01-08' AS created, '2022-01-08' AS updated, file_hash FROM ({CURRENT})",
    "ext_filter": """
SELECT * FROM (
  SELECT doc_id, 'docs/' || doc_id || '.' || ext AS path, lower(ext) AS ext
  FROM (SELECT doc_id, ['md', 'adoc', 'txt', 'PDF', 'html', 'htm', 'docx', 'csv', 'TSV', 'exe'][doc_id % 10 + 1] AS ext FROM documents)
) WHERE ext IN ('md', 'adoc', 'txt', 'pdf', 'html', 'htm', 'docx', 'csv', 'tsv')""",
    "diff_classify": f"""
SELECT c.source, CASE WHEN s.source IS NULL THEN 'new' WHEN s.file_hash = c.file_hash THEN 'unchanged' ELSE 'changed' END AS action, CAST(s.created AS VARCHAR) AS created
FROM ({CURRENT}) c LEFT JOIN ({STORED}) s ON c.source = s.source""",
    "upsert_meta": f"""
WITH s AS ({STORED}), c AS (SELECT * FROM ({CURRENT}) WHERE doc_id % 11 <> 0),
w AS (SELECT c.source, c.doc_name, coalesce(s.created, '2022-01-09') AS created, '2022-01-09' AS updated, c.file_hash FROM c LEFT JOIN s ON c.source = s.source WHERE s.source IS NULL OR s.file_hash <> c.file_hash)
SELECT * FROM w UNION ALL SELECT * FROM s WHERE source NOT IN (SELECT source FROM w)""",
    "drop_sources": f"SELECT * FROM ({STORED}) WHERE source NOT IN (SELECT 'documents/' || doc_id || '.txt' FROM documents WHERE doc_id % 3 = 0)",
    "list_docs": f"SELECT source, doc_name FROM ({STORED}) WHERE source LIKE '%ts/1_2%' ORDER BY source LIMIT 50",
    "store_status": f"""
WITH RECURSIVE {CHUNKS}
SELECT 'doc_chunk' AS name, count(*) AS row_count, 'source, doc_name, vector, chunk_id, chunk_text' AS fields FROM chunks
UNION ALL SELECT 'doc_meta', count(*), 'source, doc_name, created, updated, file_hash' FROM ({STORED})""",
    "reindex_plan": f"SELECT source, doc_name, '2022-01-09' AS created, '2022-01-09' AS updated, file_hash FROM ({CURRENT}) WHERE source IN (SELECT source FROM ({STORED}))",
    "store_reindex": f"SELECT source, doc_name, '2022-01-09' AS created, '2022-01-09' AS updated, file_hash FROM ({CURRENT}) WHERE source IN (SELECT source FROM ({STORED})) AND doc_id % 3 <> 0",
    "chunk_plain_text": f"WITH RECURSIVE {CHUNKS} SELECT * FROM chunks",
    "sql_chunks": f"WITH RECURSIVE {CHUNKS} SELECT * FROM chunks",
    "file_dispatch": """
WITH s AS (SELECT *, ['md', 'adoc', 'txt', 'html', 'csv', 'exe'][s_suppkey % 6 + 1] AS ext FROM supplier),
f AS (
  SELECT s_suppkey, ext, CASE ext WHEN 'md' THEN '# ' || s_name || chr(10) || chr(10) || 'body *of* it' || chr(10) WHEN 'adoc' THEN '== ' || s_name || chr(10) || chr(10) || 'body' || chr(10) WHEN 'html' THEN '<h1>' || s_name || '</h1><p>body</p>'
    WHEN 'csv' THEN 'name,other' || chr(10) || s_name || ',x' || chr(10) ELSE 'plain ' || s_name END AS raw,
    CASE ext WHEN 'md' THEN '# ' || s_name || chr(10) || 'body of it' WHEN 'adoc' THEN '== ' || s_name || chr(10) || 'body' WHEN 'html' THEN s_name || chr(10) || 'body' WHEN 'csv' THEN 'name: ' || s_name || ', other: x' ELSE 'plain ' || s_name END AS chunks
  FROM s WHERE ext <> 'exe'
)
SELECT s_suppkey || '.' || ext AS doc_name, ext, CAST(strlen(raw) AS BIGINT) AS size, sha256(raw) AS file_hash, chunks, CAST(NULL AS VARCHAR) AS error FROM f""",
    "merge_short": """
WITH n AS (SELECT conv_id, turn, text, row_number() OVER w AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(CASE WHEN f = 1 OR length(text) >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_id FROM n)
SELECT conv_id, CAST(chunk_id AS BIGINT) AS chunk_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS chunk_text FROM g GROUP BY ALL""",
    "section_prefix": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_id, '## ' || doc_id || chr(10) || chunk_text AS chunk_text FROM chunks",
    "adoc_sections": f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS section, CASE WHEN i = 1 THEN '== document' ELSE '=== part' END AS heading, trim(parts[i], {WS}) AS body
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM l)""",
    "md_sections": """
WITH s AS (
  SELECT p_partkey, [
    {'h': '', 'b': 'lead of ' || p_name},
    {'h': '# ' || p_name, 'b': p_type || ' and a link' || chr(10) || chr(10) || 'one' || chr(10) || chr(10) || p_name},
    {'h': '## Size', 'b': 'size ' || p_size || chr(10) || 'more' || chr(10) || chr(10) || 'code ' || p_name}] AS parts FROM part
)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(i - 1 AS BIGINT) AS section, parts[i].h AS heading, parts[i].b AS body FROM (SELECT p_partkey, parts, unnest(range(1, 4)) AS i FROM s)""",
    "csv_chunks": DELIMITED.format(delimiter=","),
    "tsv_chunks": DELIMITED.format(delimiter="' || chr(9) || '"),
    "docx_sections": """
WITH s AS (SELECT s_suppkey, [
  {'h': '', 'b': 'lead'}, {'h': '# ' || s_name, 'b': 'first ' || s_name || chr(10) || chr(10) || 'second'}, {'h': '## 見出し', 'b': 'third'}] AS parts FROM supplier)
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(i - 1 AS BIGINT) AS section, parts[i].h AS heading, parts[i].b AS body FROM (SELECT s_suppkey, parts, unnest(range(1, 4)) AS i FROM s)""",
    "json_render": r"""
SELECT s_suppkey, '{"score":' || CAST(s_suppkey / 4.0::DOUBLE AS VARCHAR) || ',"method":"Hybrid","source":"' || s_name || '","chunk_id":' || s_suppkey || ',"text":"\"' || s_name || '\"\n\\"}' AS json FROM supplier""",
    "rename_fold": """
WITH o AS (SELECT '/d/' || c_custkey || '.md' AS path, 1 AS m FROM customer),
n AS (SELECT '/d/' || CASE WHEN c_custkey % 3 = 0 THEN 'new-' ELSE '' END || c_custkey || '.md' AS path, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS m FROM customer WHERE c_custkey % 7 <> 0)
SELECT path, 'remove' AS kind FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT n.path, 'upsert' FROM n LEFT JOIN o ON n.path = o.path WHERE o.path IS NULL OR o.m <> n.m""",
    "quoted_drop": r"""SELECT s_suppkey, 'o' || chr(39) || '%_\' || s_suppkey || chr(39) AS source FROM supplier WHERE s_nationkey >= 5""",
    "row_to_text": """
SELECT s_suppkey, 's_suppkey: ' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ', s_name: ' || s_name END || ', s_nationkey: ' || s_nationkey AS line FROM supplier""",
    "pack_rows": """
WITH RECURSIVE l AS (
  SELECT c_nationkey, 'c_custkey: ' || c_custkey || ', c_name: ' || c_name AS line, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer
), f(c_nationkey, i, chunk_id, size) AS (
  SELECT c_nationkey, i, CAST(0 AS BIGINT), length(line) FROM l WHERE i = 1
  UNION ALL
  SELECT l.c_nationkey, l.i, CASE WHEN f.size + 1 + length(l.line) <= 200 THEN f.chunk_id ELSE f.chunk_id + 1 END, CASE WHEN f.size + 1 + length(l.line) <= 200 THEN f.size + 1 + length(l.line) ELSE length(l.line) END
  FROM f JOIN l ON l.c_nationkey = f.c_nationkey AND l.i = f.i + 1
)
SELECT c_nationkey, chunk_id, string_agg(line, chr(10) ORDER BY i) AS chunk_text FROM f JOIN l USING (c_nationkey, i) GROUP BY ALL""",
    "ws_normalize": f"""
WITH s AS (SELECT doc_id, '  ' || replace(text, chr(10), ' ' || chr(9) || repeat(chr(10), 4) || ' ') || chr(12288) || chr(10) AS x FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(x, '[\\t\\r\\f\\v \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) AS html_text,
  trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), {WS}) AS pdf_text FROM s""",
    "vector_topk": NEAREST,
    "vector_pruned": NEAREST,
    "mean_pool": """
WITH m AS (SELECT label, i - 1 AS pos, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL)
SELECT label, CAST(pos AS BIGINT) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM m""",
    "static_embed": """
WITH t AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM (SELECT DISTINCT p_name FROM part)),
ids AS (SELECT p_name, CASE w WHEN 'small' THEN 1 WHEN 'cold' THEN 2 WHEN 'widget' THEN 3 ELSE 0 END AS id FROM t),
m AS (SELECT p_name, pos, avg(((31 * id + 7 * pos) % 17 - 8) / 8.0::DOUBLE) AS m FROM ids, range(1024) AS g(pos) GROUP BY ALL)
SELECT p_name, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY p_name)), 3) AS x FROM m""",
    "fts_bm25_topk": f"WITH RECURSIVE {_search(ONE)} SELECT source, chunk_id, score, rank FROM fts",
    "stored_search": f"WITH RECURSIVE {_search(ONE)} SELECT source, chunk_id, score, rank FROM fts",
    "fts_blockmax": f"WITH RECURSIVE {_search('SELECT item_id AS query_id, text AS query FROM benchmark')} SELECT query_id, source, chunk_id, score, rank FROM fts",
    "stored_hybrid": f"WITH RECURSIVE {_floats(_search('SELECT item_id AS query_id, text AS query FROM benchmark'))} SELECT query_id, source, chunk_id, score, method, rank FROM fused",
    "rrf_fuse": """
WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS r, 1 AS leg FROM part QUALIFY r < 50),
b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS r, 2 AS leg FROM part QUALIFY r < 50),
f AS (SELECT p_partkey, sum(1.0::DOUBLE / (61 + r)) AS s, bit_or(leg) AS legs FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY p_partkey)
SELECT CAST(p_partkey AS BIGINT) AS chunk_id, round(s, 9) AS score, CASE legs WHEN 3 THEN 'Hybrid' WHEN 1 THEN 'Keyword' ELSE 'Semantic' END AS method,
  row_number() OVER (ORDER BY s DESC, p_partkey) - 1 AS rank FROM f QUALIFY rank < 50""",
    "adjacent_text": """
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS source, turn, text FROM conversations)
SELECT h.source, h.turn AS chunk_id, string_agg(n.text, chr(10) ORDER BY n.turn) AS text
FROM t h JOIN t n ON h.source = n.source AND n.turn BETWEEN h.turn - 1 AND h.turn + 1 GROUP BY ALL""",
    "hybrid_search": f"""
WITH RECURSIVE {_search(ONE)}
SELECT f.source, f.chunk_id, f.score, f.method, string_agg(c.chunk_text, chr(10) ORDER BY c.chunk_id) AS text, f.rank
FROM fused f JOIN c ON c.source = f.source AND c.chunk_id BETWEEN f.chunk_id - 1 AND f.chunk_id + 1 GROUP BY f.source, f.chunk_id, f.score, f.method, f.rank""",
    "hybrid_batch": f"WITH RECURSIVE {_search('SELECT item_id AS query_id, text AS query FROM benchmark')} SELECT query_id, source, chunk_id, score, method, rank FROM fused",
    "short_query": "WITH RECURSIVE " + _search("SELECT CAST(0 AS BIGINT) AS query_id, 'a' AS query") + " SELECT source, chunk_id, score, method, rank FROM fused",
    "watch_fold": "SELECT user_id, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'drop' ELSE 'upsert' END AS action FROM events GROUP BY user_id",
    "result_render": """
WITH d AS (
  SELECT doc_id, 'documents/' || doc_id || '.txt' AS source, 1.0::DOUBLE / (doc_id + 60) AS score, CASE doc_id % 3 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'Keyword' ELSE 'Semantic' END AS method, replace(text, chr(10), ' ') AS flat, text FROM documents
)
SELECT doc_id, rpad(printf('%.4f', score), 8, ' ') || ' | ' || rpad(method, 10, ' ') || ' | ' || rpad(CASE WHEN length(source) > 15 THEN substr(source, 1, 13) || '..' ELSE source END, 15, ' ') || ' | ' || CASE WHEN length(flat) > 50 THEN substr(flat, 1, 50) || '...' ELSE flat END AS line
FROM d""",
}
