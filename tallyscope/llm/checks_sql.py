"""DuckDB SQL for the queries of this folder that SQL can express."""

_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_COMPONENTS = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT both_ways.a, reach.r FROM reach JOIN both_ways ON reach.doc_id = both_ways.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY ALL"""

_BITS = "array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', substr(sha1(coalesce(html, '')), i, 1)) - 1) * 4 + 1, 4)), '')"
_FIVE = " + ".join(f"substr(bits, i * 5 + {k + 1}, 1)::INT * {1 << (4 - k)}" for k in range(5))

WARC_PAGES = f"""WITH b AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, {_BITS} AS bits FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS intact FROM f"""

_KEPT_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BENCHMARK_HITS = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_KEPT_WORDS}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_KEPT_WORDS}') AS w FROM benchmark),
p AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda k: w[k:k + 9])) AS x FROM i WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, x FROM p),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, w FROM d),
hits AS (SELECT doc_id, k, len(x) AS n, item_id FROM places JOIN phrases ON len(x) = 10 AND w[k:k + 9] = x
    UNION ALL SELECT doc_id, k, len(x), item_id FROM places JOIN (SELECT * FROM phrases WHERE len(x) < 10) ON w[k:k + len(x) - 1] = x),
words AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, coalesce(items.h, sha256('')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

FILL_IN_MIDDLE = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
g AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS r FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || r || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || r || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s"""

HARD_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3"""
