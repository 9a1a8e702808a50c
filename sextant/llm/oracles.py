"""DuckDB SQL for the corpus operators' queries that SQL can express."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (SELECT a AS v, a AS r FROM link UNION SELECT reach.v, link.b FROM reach JOIN link ON link.a = reach.r),
low AS (SELECT v, min(r) AS label FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(low.label, d.doc_id) AS BIGINT) AS component_id,
       coalesce(low.label, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.v = d.doc_id
"""

REPEATS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, p, ws[p] AS word, CASE WHEN p + 12 <= len(ws) THEN array_to_string(ws[p:p + 12], ' ') END AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
first AS (SELECT k, min(doc_id) AS d FROM pos WHERE k IS NOT NULL GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM pos JOIN first USING (k) WHERE d < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

BACKOFF = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
pos AS (SELECT r, p, ws[p] AS g1, CASE WHEN p > 1 THEN array_to_string(ws[p - 1:p], ' ') END AS g2, CASE WHEN p > 2 THEN array_to_string(ws[p - 2:p], ' ') END AS g3
        FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
c AS (SELECT r, p,
             count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY g1, r) AS c1, count(*) OVER () - count(*) OVER (PARTITION BY r) AS n,
             CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY g2, r) END AS c2,
             CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY g3, r) END AS c3
      FROM pos),
h AS (SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY p) AS h1, lag(c2) OVER (PARTITION BY r ORDER BY p) AS h2 FROM c),
s AS (SELECT r, CASE WHEN c3 > 0 THEN ln(CAST(c3 AS DOUBLE) / h2)
                     WHEN c2 > 0 THEN ln(CAST(c2 AS DOUBLE) / h1) + (least(p - 1, 2) - 1) * ln(0.4e0)
                     ELSE ln(CAST(greatest(c1, 1) AS DOUBLE) / greatest(n, 1)) + least(p - 1, 2) * ln(0.4e0) END AS x
      FROM h),
m AS (SELECT r, sum(CAST(floor(x * 1e6 + 0.5) AS BIGINT)) AS score FROM s GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(score, 0) AS BIGINT) AS score_micro,
       CASE WHEN len(ws) > 0 THEN CAST(floor(CAST(coalesce(score, 0) AS DOUBLE) / len(ws)) AS BIGINT) END AS mean_micro
FROM w LEFT JOIN m USING (r)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS v, a AS r FROM link UNION SELECT reach.v, link.b FROM reach JOIN link ON link.a = reach.r),
low AS (SELECT v, min(r) AS label FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(low.label, vec_id) AS BIGINT) AS component_id, coalesce(low.label, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.v = vec_id
"""
