"""DuckDB twins of the operators that SQL can express, each by a plainer way than the operator's."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(h, i, 1))]), '') AS bits, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * j + 1, 1) AS BIGINT) + 8 * CAST(substr(bits, 5 * j + 2, 1) AS BIGINT) + 4 * CAST(substr(bits, 5 * j + 3, 1) AS BIGINT) + 2 * CAST(substr(bits, 5 * j + 4, 1) AS BIGINT) + CAST(substr(bits, 5 * j + 5, 1) AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM b
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[ix:ix + k - 1], ' ') AS gram FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS ix FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, k, ix, array_to_string(w[ix:ix + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS ix FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT g.doc_id, g.ix, g.k, win.item_id FROM g JOIN win ON g.k = win.k AND g.gram = win.gram),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(ix, ix + k)) AS p FROM hit) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[ix:ix + k - 1], ' ') AS e FROM (SELECT doc_id, w, least(3, len(w)) AS k, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS ix FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY 1) r ON d.doc_id = r.a
"""

LINES = r"""
WITH l AS (SELECT doc_id, no - 1 AS no, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)),
u AS (SELECT list_sort(w) AS w, min(doc_id * 1000000 + no) AS first, len(w) AS n FROM l WHERE len(w) > 0 GROUP BY list_sort(w), len(w)),
t AS (SELECT first, n, w, unnest(w) AS word FROM u),
f AS (SELECT word, count(*) AS c FROM t GROUP BY 1),
p AS (SELECT t.first, t.n, t.w, t.word, row_number() OVER (PARTITION BY t.first ORDER BY f.c, t.word) AS r FROM t JOIN f ON t.word = f.word),
x AS (SELECT * FROM p WHERE r <= n - ceil(0.8::DOUBLE * n - 0.000001) + 1),
c AS (SELECT DISTINCT a.first AS a, b.first AS b FROM x a JOIN x b ON a.word = b.word AND a.first < b.first AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
gone AS (SELECT DISTINCT c.b FROM c JOIN u a ON c.a = a.first JOIN u b ON c.b = b.first WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
r AS (SELECT l.doc_id, l.no FROM l JOIN u ON list_sort(l.w) = u.w LEFT JOIN gone g ON u.first = g.b WHERE g.b IS NOT NULL OR l.doc_id * 1000000 + l.no <> u.first),
s AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS removed FROM r GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, ix, md5(substr(h, 2 * ix + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS ix FROM d WHERE len(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY 1),
hit AS (SELECT g.doc_id, g.ix, lag(g.ix) OVER (PARTITION BY g.doc_id ORDER BY g.ix) AS before FROM g JOIN f ON g.s = f.s WHERE f.first < g.doc_id),
run AS (SELECT *, sum(CASE WHEN before IS NULL OR ix > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ix) AS no FROM hit),
runs AS (SELECT doc_id, no, min(ix) AS low, max(ix) + 50 AS high FROM run GROUP BY 1, 2),
cut AS (SELECT r.doc_id, no, low, high, coalesce(lag(high) OVER (PARTITION BY r.doc_id ORDER BY low), 0) AS since FROM runs r),
kept AS (SELECT c.doc_id, string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (low - since) AS BIGINT)), '' ORDER BY low) AS pieces, max(high) AS high, sum(high - low) AS gone, count(*) AS runs FROM cut c JOIN d ON c.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE pieces || substr(h, CAST(2 * high + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

MINHASH = JACCARD.replace("least(3, len(w))", "least(2, len(w))").replace("100 * common >= 90 *", "100 * common >= 80 *").replace("AS component_id FROM d", "AS component_id, d.doc_id = least(d.doc_id, coalesce(r.least, d.doc_id)) AS kept FROM d")

RANKING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
z AS (SELECT count(*) FILTER (len(t) > 0) AS big_n, sum(len(t))::BIGINT AS big_l FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, z GROUP BY 1),
s AS (SELECT item_id, doc_id, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN p ON q.term = p.term JOIN w ON q.term = w.term, z GROUP BY 1, 2)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 20
"""

NEGATIVES = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.q) = len(c.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE alike) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
