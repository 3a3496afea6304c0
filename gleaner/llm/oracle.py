"""SQL twins of those queries that SQL can express, for DuckDB."""

#: Integer inner products of every hundredth vector with all others.
EXACT_TOPK = """WITH q8 AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT * FROM (SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM q8 q, q8 c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= 10"""
#: Windows of 50 words that also start in an earlier document.
COVER_DEDUP = """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
p AS (SELECT w.doc_id, t.i, w.w[t.i] AS word FROM w, unnest(range(1, len(w.w) + 1)) AS t(i)),
flag AS (SELECT p.doc_id, p.i, word, coalesce(max(g.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM flag GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
#: An exact join over prefixes of rare two-word shingles, and the closure of its links.
NEAR_DUPLICATES = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(s) AS h, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
k AS (SELECT sh.doc_id, s, n, row_number() OVER (PARTITION BY sh.doc_id ORDER BY df, s) AS r FROM sh JOIN n USING (doc_id) JOIN (SELECT s, count(*) AS df FROM sh GROUP BY 1) USING (s)),
pre AS (SELECT * FROM k WHERE r <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.s = b.s AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM (SELECT a, b, na, nb, count(*) AS c FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s GROUP BY ALL) WHERE 100 * c >= 80 * (na + nb - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, l.b FROM reach r JOIN sym l ON l.a = r.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)"""

#: Windows of 100 bytes, as hex digits, that also start earlier; the gaps between the runs they cover are kept.
SUFFIX_DEDUP = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM h)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, i, coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) AS before FROM gone),
runs AS (SELECT doc_id, i, sum(CASE WHEN i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM cover),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM spans),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * c + 1, 2 * (a - c)) || CASE WHEN last THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS t FROM gaps JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, x))) AS kept_sha256 FROM h LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL = {"op5_suffix_dedup": SUFFIX_DEDUP, "op4_near_duplicates": NEAR_DUPLICATES, "op6_cover_dedup": COVER_DEDUP, "op8_exact_topk": EXACT_TOPK}
