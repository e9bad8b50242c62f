"""DuckDB texts of the corpus queries that SQL can express."""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

# Checksum by table steps of 8 bits; the jump hash as a recursion with 64-bit wrap-around in HUGEINT.
SHARDING = """
WITH RECURSIVE
 bit(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i)
   UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bit WHERE k < 8),
 tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bit WHERE k = 8),
 d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(strlen(text), 0) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
 crc AS MATERIALIZED (SELECT r, doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(h) // 2),
     lambda x: ('0x' || h[2 * x + 1:2 * x + 2])::BIGINT)), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]))) AS text_crc32 FROM d, tab),
 jump(r, n, key, spot, nxt) AS (
   SELECT r, n, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END, 0::BIGINT, 0::BIGINT FROM d, (VALUES (24), (25)) s(n)
   UNION ALL SELECT r, n, k2, nxt, floor((nxt + 1) * (2147483648::DOUBLE / (k2 // 8589934592 + 1)::DOUBLE))::BIGINT
   FROM (SELECT r, n, nxt, (((key // 4294967296) * 2862933555777941757 % 4294967296) * 4294967296 + (key % 4294967296) * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM jump WHERE nxt < n)),
 shard AS (SELECT r, n, max(spot) AS s FROM jump GROUP BY r, n)
SELECT c.doc_id, c.size, c.text_crc32, 'key' AS law, a.s::INTEGER AS shard, row_number() OVER (PARTITION BY a.s ORDER BY c.doc_id NULLS FIRST, c.size, c.text_crc32) - 1 AS slot, b.s::INTEGER AS grown_shard
FROM crc c JOIN shard a ON a.r = c.r AND a.n = 24 JOIN shard b ON b.r = c.r AND b.n = 25"""

# Windows as joined words; every word position is looked up for each window length that occurs.
DECONTAMINATION = """
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
 win AS (SELECT DISTINCT item_id, k, list_aggregate(ws[i:i + k - 1], 'string_agg', ' ') AS g
   FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
 ks AS (SELECT DISTINCT k FROM win),
 pos AS (SELECT r, k, i, list_aggregate(ws[i:i + k - 1], 'string_agg', ' ') AS g FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k)),
 hit AS MATERIALIZED (SELECT DISTINCT r, pos.k, i, item_id FROM pos JOIN win ON pos.k = win.k AND pos.g = win.g),
 words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
 its AS (SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
 coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words USING (r) LEFT JOIN its USING (r)"""

NEAR_DEDUP = """
WITH RECURSIVE
 w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE len(ws) WHEN 0 THEN [] WHEN 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 edge AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
 comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)"""

WARC = """
SELECT page_id, strlen(p) AS payload_bytes, sha256(p) AS payload_digest, CASE WHEN strlen(p) >= 100 AND page_id > first_ THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN strlen(p) >= 100 AND page_id > first_ THEN first_ END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS p, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_ FROM pages)"""

# Units as a list; the parts are rebuilt from its slices, the restored text is the text itself.
FILL_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
 u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
   ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
 c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
 p AS (SELECT doc_id, t, n, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(t) AS restored_sha256
FROM p"""

# Every anchor against every row, windows by a join on the score limits.
HARD_NEGATIVES = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
   FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5"""

# The pages of the table hold one article element without attributes; SQL takes what it encloses.
HTML_TEXT = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
 t AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
 c AS (SELECT page_id, url, replace(replace(replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)) AS t FROM t),
 s AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM s"""
