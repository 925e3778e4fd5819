"""DuckDB SQL for the queries that SQL expresses."""

SQL: dict[str, str] = {}

SQL["op4_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source
), r AS (
  SELECT *, 2.0 * source_size AS room, CASE src % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM s
), l AS (
  SELECT *, CAST(room AS DOUBLE) / w AS ratio, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(CAST(room AS DOUBLE)) OVER (ORDER BY CAST(room AS DOUBLE) / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(CAST(w AS DOUBLE)) OVER (ORDER BY CAST(room AS DOUBLE) / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, src, source_size, CAST(least(CASE WHEN level >= ratio THEN CAST(room AS DOUBLE) ELSE w * (SELECT arg_min(level, ratio) FROM l WHERE level < ratio) END, CAST(room AS DOUBLE)) AS DOUBLE) AS target FROM l
), p AS (
  SELECT d.doc_id, t.src, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY t.src ORDER BY md5(d.doc_id || ':17'), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT CAST(greatest(1, least(4096, ceil(sum(CAST(floor(target) AS BIGINT)) / 65536))) AS BIGINT) AS block FROM t
), o AS (
  SELECT t.src, CAST(ceil(CAST(floor(target) AS DOUBLE) / block) AS BIGINT) AS quota FROM t, b WHERE floor(target) > 0
), h AS (
  SELECT src, quota, CAST(sum(quota) OVER (ORDER BY src) AS BIGINT) AS hi, CAST(sum(quota) OVER () AS BIGINT) AS total FROM o
), z AS (
  SELECT slot, CAST(floor(CAST((slot % 2147483648) * 1327217885 % 2147483648 * total AS DOUBLE) / 2147483648) AS BIGINT) AS place
  FROM (SELECT max(total) AS total, unnest(range(max(total))) AS slot FROM h)
), g AS (
  SELECT src, quota, total, slot, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS block FROM z JOIN h ON place >= hi - quota AND place < hi
), n AS (
  SELECT src, count(*) AS n FROM g GROUP BY src
), k AS (
  SELECT src, block, slot FROM g WHERE block < quota
  UNION ALL SELECT src, block, total + block FROM (SELECT h.src, total, unnest(range(coalesce(n, 0), quota)) AS block FROM h LEFT JOIN n USING (src))
)
SELECT doc_id, size, source_size, target,
  CAST(least(size, greatest(0, words - start)) + least(size, greatest(0, words - source_size - start)) AS BIGINT) AS taken, CAST(k.slot AS BIGINT) AS first_slot
FROM p CROSS JOIN b LEFT JOIN k ON size > 0 AND start < words AND k.src = p.src AND k.block = start // b.block
"""

# Base 32 of SHA-1: 160 bits in groups of five.
SQL["op10_warc_revisits"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, hex,
    list_aggregate(list_transform(range(40), lambda i: lpad(bin(CAST(strpos('0123456789abcdef', hex[CAST(i + 1 AS INT):CAST(i + 1 AS INT)]) - 1 AS INT)), 4, '0')), 'string_agg', '') AS bits
  FROM p
), e AS (
  SELECT page_id, payload_bytes, hex,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * i + 1:5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2:5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3:5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4:5 * i + 4] AS INT) + CAST(bits[5 * i + 5:5 * i + 5] AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS first_id
  FROM b
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM e
"""

SQL["op5_site_lines"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), p AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), c AS (
  SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_filter(lines, lambda x: trim(x) <> ''))) AS line FROM d) GROUP BY ALL
), b AS (
  SELECT c.source, list(line) AS bad FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE n >= 5 AND n > CAST(0.1 AS DOUBLE) * pages GROUP BY c.source
), k AS (
  SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
), t AS (
  SELECT doc_id, coalesce(len(lines), 0) AS a, coalesce(len(kept), 0) AS b, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
)
SELECT doc_id, CAST(a AS BIGINT) AS n_lines, CAST(a - b AS BIGINT) AS n_dropped, CAST(length(text) AS BIGINT) AS n_kept_chars, sha256(text) AS kept_sha256 FROM t
"""

SQL["op8_exact_topk"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
