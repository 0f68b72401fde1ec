"""SQL for the corpus queries that SQL can express, to be run by DuckDB on the same tables."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# A CRC-32 from its definition: a table for each byte, then a fold over the bytes.
_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, i::BIGINT)) AS crc_table"
_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT), lambda c, b: xor(crc_table[1 + (xor(c, b) & 255)], c // 256), 4294967295::BIGINT), 4294967295::BIGINT)"

SHARDS = f"""
WITH crc AS ({_TABLE}),
d AS (SELECT doc_id, source, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, {_CRC} AS text_crc32, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents, crc),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS share FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY share, h, doc_id, source) - 1 AS pos, count(*) OVER () AS n FROM r),
s AS (SELECT *, (pos * 24) // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (pos - (shard * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""

_HOST = LOWER.format("coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), '')")
_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_QUERY = "regexp_extract({0}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1)"
_NODE = f"CASE WHEN {_HOST} <> '' THEN {_HOST} || {_PATH} || {_QUERY} END"
_LINK = """regexp_extract(html, '(?is)<link\\b[^<>]*\\brel\\s*=\\s*["'']?canonical\\b[^<>]*>', 0)"""
_HREF = """regexp_extract({0}, '(?is)\\bhref\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''<>]+))', {1})"""
_REFRESH = """regexp_extract(regexp_extract(html, '(?is)<meta\\b[^<>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^<>]*>', 0), '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''<>\\s]+)', 1)"""
_FOLDER = "regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1)"
_RESOLVED = f"CASE WHEN target LIKE '%://%' THEN target WHEN target LIKE '//%' THEN 'http:' || target WHEN target LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target ELSE rtrim({_FOLDER}, '/') || '/' || target END"

URLS = f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')) v(verdict, rule)),
p AS (SELECT page_id, url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, {_NODE.format("url")} AS node,
  [{" || ".join(_HREF.format(_LINK, k) for k in (1, 2, 3))}, {_REFRESH}] AS targets FROM pages),
l AS (SELECT url, node AS a, trim(unnest(targets)) AS target FROM p),
e0 AS (SELECT a, {_NODE.format("(" + _RESOLVED + ")")} AS b FROM l WHERE target <> ''),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
n AS (SELECT DISTINCT a AS node, {_HOST.format("'://' || a")} AS host, {_PATH.format("'://' || a")} AS path FROM e),
fits AS (SELECT x.host, x.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM (SELECT DISTINCT host, path FROM p UNION SELECT host, path FROM n) x JOIN rules r
  ON (x.host = split_part(r.rule, '/', 1) OR ends_with(x.host, '.' || split_part(r.rule, '/', 1))) AND starts_with(x.path, substr(r.rule, strpos(r.rule, '/'))) GROUP BY 1, 2),
said AS (SELECT reach.a AS node, bool_or(f.verdict = 'block') AS blocks, bool_or(f.verdict = 'allow') AS allows FROM reach JOIN n ON n.node = reach.b LEFT JOIN fits f ON f.host = n.host AND f.path = n.path GROUP BY 1)
SELECT page_id, p.host, p.path, f.rule, CASE WHEN f.rule IS NOT NULL THEN f.verdict WHEN coalesce(blocks, false) AND NOT coalesce(allows, false) THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path LEFT JOIN said ON said.node = p.node
"""

_WORDS = f"regexp_extract_all({LOWER.format('coalesce(text, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS = f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS t FROM iw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM windows))),
found AS (SELECT doc_id, dw.k, s, item_id FROM dw JOIN windows USING (k, t)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SPACED = f"regexp_extract_all({LOWER.format('coalesce(text, chr(32))')}, '[^\\x20\\x09-\\x0D]+')"
NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
e0 AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN c USING (doc_id)
"""
