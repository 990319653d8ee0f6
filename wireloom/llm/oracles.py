"""SQL for queries whose results DuckDB can compute by brute force on small tables."""

OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), pos AS (
  SELECT rid, doc_id, ws, unnest(range(1, greatest(len(ws) - 12, 0) + 1)) AS i FROM d WHERE doc_id IS NOT NULL
), win AS (
  SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM pos
), hit AS (
  SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS low FROM win) WHERE low < doc_id
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 13)) AS k FROM hit
), w AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM d
), kept AS (
  SELECT w.rid, count(gone.k) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY w.k) FILTER (gone.k IS NULL), '') AS kept
  FROM w LEFT JOIN gone ON w.rid = gone.rid AND w.k = gone.k GROUP BY w.rid
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
  SELECT rid, vec_id, list_transform(e, lambda x: coalesce(x, 0)) AS e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.rid, a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.rid <> b.rid AND list_cosine_similarity(a.e, b.e) >= 0.95
), r(a, b) AS (
  SELECT DISTINCT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (
  SELECT a, min(b) AS low FROM r GROUP BY a
), n AS (
  SELECT rid, count(*) AS n FROM l GROUP BY rid
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, c.low) AS component_id,
       coalesce(v.vec_id = least(v.vec_id, c.low), true) AS kept
FROM v LEFT JOIN n USING (rid) LEFT JOIN c ON c.a = v.vec_id
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), pos AS (
  SELECT rid, doc_id, ws, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 3, 1) + 1 END)) AS i FROM d
), s AS (
  SELECT DISTINCT rid, doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM pos
), n AS (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), p AS (
  SELECT a.rid AS x, b.rid AS y, any_value(a.doc_id) AS a, any_value(b.doc_id) AS b, count(*) AS shared
  FROM s a JOIN s b ON a.s = b.s AND a.rid <> b.rid WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY a.rid, b.rid
), l AS (
  SELECT DISTINCT p.a, p.b FROM p JOIN n n1 ON n1.rid = p.x JOIN n n2 ON n2.rid = p.y WHERE 100 * shared >= 85 * (n1.n + n2.n - shared)
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (
  SELECT a, min(b) AS low FROM r GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, c.low) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN c ON c.a = d.doc_id
"""
