"""SQL for the driver's comparison (DuckDB) where it can express a query."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), it AS (
  SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM it WHERE len(w) > 0)
), lens AS (SELECT DISTINCT k FROM win
), dw AS (
  SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)
), hits AS (SELECT rid, i, dw.k AS k, item_id FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k
), pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid)
"""



def _hash(seed: int, *cols: str) -> str:
    parts = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in cols)
    return f"(('0x' || substr(md5('{seed}|' || {parts}), 1, 15))::BIGINT)"


OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), p AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), t AS (
  -- The water level: the first at which the next source to fill is not above its cap.
  SELECT source, source_size, least(cap, w * coalesce((SELECT arg_min(level, k) FROM p WHERE w * level <= cap), 1e300)) AS target FROM p
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), r AS (SELECT *, CAST(floor(target - whole * source_size) AS BIGINT) AS rest FROM q
), keys AS (
  SELECT source, doc_id, size, {_hash(17, "doc_id", "size")} AS h, sum(size) AS words FROM d GROUP BY ALL
), c AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keys
), f AS (
  SELECT c.source, c.doc_id, c.size, whole, rest - before AS room, source_size, target FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
), n AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) - 1 AS nth FROM d
)
SELECT n.doc_id, n.source, n.size, source_size, target, CAST(whole * n.size + greatest(0, least(n.size, room - nth * n.size)) AS BIGINT) AS taken
FROM n JOIN f ON n.source IS NOT DISTINCT FROM f.source AND n.doc_id IS NOT DISTINCT FROM f.doc_id AND n.size = f.size
"""

OP2 = rf"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda k, z: CASE WHEN k % 2 = 1 THEN xor(k // 2, 3988292384) ELSE k // 2 END)) AS t
), x AS (
  SELECT text, hex(encode(text)) AS x FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL AND text <> '')
), crcs AS (
  SELECT text, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda crc, b: xor(crc // 256, t[xor(crc, b) % 256 + 1]))) AS crc FROM x, tab
), d AS (
  SELECT doc_id, CAST(coalesce(strlen(d.text), 0) + 1 AS BIGINT) AS size, CAST(coalesce(crc, 0) AS BIGINT) AS text_crc32, {_hash(30, "doc_id")} % 6 AS old FROM documents d LEFT JOIN crcs ON d.text = crcs.text
), e AS (
  SELECT *, {_hash(29, "doc_id", "text_crc32", "nth")} AS h FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text_crc32, size) - 1 AS nth FROM d)
), tot AS (SELECT sum(size) AS total FROM e
), caps AS (SELECT j, total // 8 + CASE WHEN j < total % 8 THEN 1 ELSE 0 END AS cap FROM tot, range(8) AS g(j)
), olds AS (SELECT i, coalesce((SELECT sum(size) FROM e WHERE old = i), 0) AS size FROM range(6) AS g(i)
), gives AS (SELECT i, least(size, cap) AS stay FROM olds JOIN caps ON i = j
), takes AS (SELECT j, cap - coalesce(stay, 0) AS room, sum(cap - coalesce(stay, 0)) OVER (ORDER BY j) AS top FROM caps LEFT JOIN gives ON i = j
), seen AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY old ORDER BY size <= (SELECT greatest(1, total // (8 * 4096)) FROM tot), h, doc_id NULLS FIRST, text_crc32, size, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e
), k AS (
  -- What stays in its shard; the point of rounding differs by shard.
  SELECT seen.*, before + size * (1.0::DOUBLE - (old + 0.5::DOUBLE) / 6.0::DOUBLE) < stay AS stays FROM seen JOIN gives ON i = old
), t AS (
  SELECT *, coalesce(sum(tail) OVER (ORDER BY old ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - kept AS shift, sum(tail) OVER () AS tails
  FROM (SELECT old, coalesce(sum(size) FILTER (stays), 0) AS kept, coalesce(sum(size) FILTER (NOT stays), 0) AS tail FROM k GROUP BY old)
), ends AS (
  -- The line of what does not stay, cut in proportion to what each receiving shard lacks.
  SELECT j, CASE WHEN top = max(top) OVER () THEN 1e300 ELSE top::DOUBLE * (SELECT max(tails) FROM t) / (max(top) OVER ())::DOUBLE END AS stop FROM takes WHERE room > 0
), placed AS (
  SELECT k.*, CASE WHEN stays THEN old ELSE (SELECT min(j) FROM ends WHERE stop > before + shift + size / 2.0::DOUBLE) END AS shard FROM k JOIN t USING (old)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, text_crc32, size, nth) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

#: Bytes by their hex digits; grey areas as whole numbers: an 8 x 9 tile of h rows of 64 pixels.
OP3 = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda k, z: CASE WHEN k % 2 = 1 THEN xor(k // 2, 3988292384) ELSE k // 2 END)) AS t
), d AS (
  SELECT text, payload, strlen(payload) // 192 AS h, hex(encode(payload)) AS x
  FROM (SELECT text, text || repeat(' ', greatest(1, (strlen(text) + 191) // 192) * 192 - strlen(text)) AS payload FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents))
), b AS (SELECT text, h, unnest(regexp_extract_all(x, '..')) AS byte, unnest(range(h * 192)) AS p FROM d
), px AS (
  SELECT text, h, p // 192 AS y, (p % 192) // 3 AS c, sum(('0x' || byte)::BIGINT * CASE p % 3 WHEN 0 THEN 299 WHEN 1 THEN 587 ELSE 114 END) AS grey FROM b GROUP BY ALL
), r AS (
  SELECT text, h, y, k, sum(grey * (least(9 * c + 9, 64 * k + 64) - greatest(9 * c, 64 * k))) AS v FROM px JOIN range(9) AS g(k) ON 9 * c < 64 * k + 64 AND 64 * k < 9 * c + 9 GROUP BY ALL
), cell AS (
  SELECT text, h, j, k, CAST(sum(v * (least(8 * y + 8, h * j + h) - greatest(8 * y, h * j))) AS HUGEINT) AS v FROM r JOIN range(8) AS g(j) ON 8 * y < h * j + h AND h * j < 8 * y + 8 GROUP BY ALL
), bits AS (
  SELECT text, j, sum(CASE WHEN k > 0 AND v > last THEN 1 << (8 - k) ELSE 0 END)::BIGINT AS bits, string_agg(printf('%02x', ((2 * v + 64000 * h) // (128000 * h))::BIGINT), '' ORDER BY k) AS line
  FROM (SELECT *, lag(v) OVER (PARTITION BY text, j ORDER BY k) AS last FROM cell) GROUP BY ALL
), f AS (SELECT text, string_agg(printf('%02x', bits), '' ORDER BY j) AS feature, string_agg(line, '' ORDER BY j) AS tile FROM bits GROUP BY text
), m AS (
  SELECT d.text, feature, tile, payload, 'P6' || chr(10) || '64 ' || h || chr(10) || '255' || chr(10) || payload AS media,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(16), lambda i: ('0x' || substr(right(x, 32), 2 * i + 1, 2))::BIGINT)), lambda crc, b: xor(crc // 256, t[xor(crc, b) % 256 + 1]))) AS tail
  FROM d JOIN f USING (text), tab
)
SELECT doc_id, CAST(strlen(m.text) AS BIGINT) AS n_bytes, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256, CAST(tail AS BIGINT) AS tail_crc32, CAST(strlen(media) AS BIGINT) AS media_bytes,
  sha256(media) AS media_sha256, feature, sha256(unhex('934e554d50590100' || '7600' || hex(encode(rpad('{''descr'': ''|u1'', ''fortran_order'': False, ''shape'': (8, 9), }', 117, ' ') || chr(10))) || tile)) AS tile_sha256
FROM documents JOIN m ON coalesce(documents.text, '') = m.text
"""

OP4 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid
), both_sides AS (SELECT a.rid AS a, b.rid AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL
), links AS (SELECT a, b FROM both_sides JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * o >= 90 * (x.n + y.n - o)
), reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT x.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(y.doc_id) AS component_id
FROM d x JOIN reach ON reach.a = x.rid JOIN d y ON y.rid = reach.b LEFT JOIN n ON n.rid = x.rid GROUP BY x.rid, x.doc_id
"""

#: What the extraction must find on the tables' layout: the blocks of the article element.
OP5 = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' '), '</?(p|h1)>', chr(1), 'g') AS x FROM pages
), b AS (
  SELECT page_id, url, list_transform(string_split(regexp_replace(x, '<[^>]*>', '', 'g'), chr(1)),
    lambda s: trim(regexp_replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM a
)
SELECT page_id, url, array_to_string(list_filter(parts, lambda s: s <> ''), chr(10)) AS text, CAST(length(array_to_string(list_filter(parts, lambda s: s <> ''), chr(10))) AS BIGINT) AS n_chars FROM b
"""

OP10 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, url, strlen(html) AS size, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, url, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * i // 4 + 1, 2))::INT >> (3 - 5 * i % 4)::INT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM g
"""

ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1, "op2_sharding": OP2, "op3_media": OP3, "op4_ngram_join": OP4, "op5_html": OP5, "op7_decontaminate": OP7, "op10_warc": OP10}


def _op9() -> str:
    from shiori.llm.secrets import RULES

    def spans(i, rule):
        pattern = rule.pattern.replace("'", "''")
        ok = f"length(regexp_extract(h, '{pattern}', {rule.group})) >= {rule.least}"
        return f"""
SELECT rid, {i} AS kind, start, start + length(h) AS stop FROM (
  SELECT rid, hits[i] AS h, list_sum(list_transform(gaps[1 : i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda g: length(g))), 0) AS start
  FROM (SELECT rid, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM d))
) WHERE {ok}"""

    kinds = "CASE kind " + " ".join(f"WHEN {i} THEN '{r.kind}'" for i, r in enumerate(RULES)) + " END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), s AS ({" UNION ALL ".join(spans(i, r) for i, r in enumerate(RULES))}
), n AS (SELECT rid, kind, start, {kinds} || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM s
), g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM n GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


ORACLE_SQL["op9_secrets"] = _op9()
