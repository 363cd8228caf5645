"""SQL for the queries that SQL can express on whole tables."""

#: Windows of 100 bytes as hexadecimal text; each but the first of its kind marks 100 bytes, whose runs are cut out.
OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS k FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS s FROM d)),
r AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
g AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true)::INT AS new FROM r),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
p AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS e FROM i GROUP BY doc_id, run),
q AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
c AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(e) + 1) AS kept
  FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

#: Sets of word 5-grams, all pairs that share one, similarity of 4/5 or more, and the least id that can be reached.
OP10 = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS t FROM documents),
i AS (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 2))) AS k FROM w WHERE len(t) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(t[k:k + 4], chr(31)) AS g FROM i),
n AS (SELECT doc_id, count(*) AS n_grams FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT l, r FROM p JOIN n x ON x.doc_id = l JOIN n y ON y.doc_id = r WHERE 9 * c >= 4 * (x.n_grams + y.n_grams)),
e AS (SELECT l, r FROM k UNION ALL SELECT r, l FROM k),
reach(x, y) AS (SELECT l, r FROM e UNION SELECT reach.x, e.r FROM reach JOIN e ON reach.y = e.l),
m AS (SELECT x, least(x, min(y)) AS root FROM reach GROUP BY x),
f AS (SELECT l, count(*) AS n_links FROM e GROUP BY l)
SELECT doc_id, coalesce(root, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_grams, 0) AS n_grams
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = doc_id LEFT JOIN f ON f.l = doc_id
"""

#: Words by bucket of all documents and all benchmark texts, whole-number gains, seeded noise, ranks of the highest tenth.
OP11 = """
WITH RECURSIVE crc_step AS (SELECT i AS byte, 0 AS k, i::UBIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT byte, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM crc_step WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM crc_step WHERE k = 8),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS f FROM documents),
v AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS f FROM benchmark),
u AS (SELECT doc_id, unnest(f) AS f FROM w),
all_f AS (SELECT DISTINCT f FROM (SELECT f FROM u UNION ALL SELECT f FROM v)),
h AS (SELECT f, hex(encode(f)) AS x FROM all_f),
b AS (SELECT f, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)),
  lambda a, y: xor(a // 256, t[xor(a % 256, y)::BIGINT + 1])), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS n FROM u JOIN b USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM v JOIN b USING (f) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (n.s + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (n.t + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), n),
d AS (SELECT doc_id, sum(gain) AS weight FROM u JOIN b USING (f) JOIN g USING (bucket) GROUP BY doc_id),
c AS (SELECT doc_id, len(f) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) // 10 FROM r) THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)
"""

#: All inner products of the queries with all other rows.
OP12 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p
QUALIFY rank <= 20
"""
