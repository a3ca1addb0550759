"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), k AS (
  SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), keyed AS (
  SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM k
), gone AS (
  SELECT key AS gone FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone ON key = gone GROUP BY rid
"""

MIX_SOURCES = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(md5(text), '') AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS i,
         (SELECT sum(source_size) FROM s)::BIGINT AS total FROM s
), p AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights FROM r
), share AS (
  SELECT (total - before)::DOUBLE / weights::DOUBLE AS share FROM p WHERE cap > w * ((total - before)::DOUBLE / weights::DOUBLE)
  ORDER BY i LIMIT 1
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, w * coalesce((SELECT share FROM share), 0.0)) AS target FROM r
), u AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || h), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u
"""

WARC_ROUND_TRIP = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         row_number() OVER (PARTITION BY sha256(coalesce(html, '')) ORDER BY page_id NULLS LAST) AS n,
         first_value(page_id) OVER (PARTITION BY sha256(coalesce(html, '')) ORDER BY page_id NULLS LAST) AS first_id
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN n > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND payload_bytes >= 100 THEN first_id END AS refers_to
FROM p
"""

EXACT_TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.uid AS quid, q.vec_id AS query_id, c.vec_id, c.uid, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.uid <> c.uid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY quid ORDER BY score DESC, vec_id, uid)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

VECTOR_RANGE_JOIN = """
WITH RECURSIVE r AS (
  SELECT row_number() OVER () AS uid, vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
), v AS MATERIALIZED (
  SELECT * FROM r WHERE vec_id IS NOT NULL AND len(e) > 0
    AND len([1 FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([1 FOR x IN e IF x <> 0]) > 0
), links AS (
  SELECT a.uid, b.uid AS other, b.vec_id AS id FROM v a JOIN v b ON a.uid <> b.uid AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END
), reach AS (
  SELECT uid, uid AS at, vec_id AS id FROM r
  UNION
  SELECT reach.uid, links.other, links.id FROM reach JOIN links ON links.uid = reach.at
), least AS (
  SELECT uid, min(id) AS component_id FROM reach GROUP BY uid
), n AS (
  SELECT uid, count(*) AS n FROM links GROUP BY uid
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM r JOIN least USING (uid) LEFT JOIN n USING (uid)
"""

ORACLE = {
    "op13_vector_range_join": VECTOR_RANGE_JOIN,
    "op4_warc_segments": WARC_ROUND_TRIP,
    "op6_exact_top_k": EXACT_TOP_K,
    "op3_line_dedup": LINE_DEDUP,
    "op10_mix_sources": MIX_SOURCES,
}
