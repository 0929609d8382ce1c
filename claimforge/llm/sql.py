"""DuckDB SQL for the operators that SQL can express."""

WORD = "[^ \\t-\\r]+"

#: Sainte-Lague quotas written out seat by seat for sources, which the operator never lists, and the same seeded selection.
MIX = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (((coalesce(doc_id, -1) % 2147483647 + 2147483647) % 2147483647 + 20240) % 2147483647 * 48271 + 12345) % 2147483647 AS a1
  FROM documents),
hashed AS (SELECT doc_id, source, size, ((a1 * 48271 + 12345) % 2147483647 * 48271 + 12345) % 2147483647 AS at FROM base),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM hashed GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM src),
leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM weighed),
aimed AS (
  SELECT source, source_size, CASE WHEN cap / w < lev THEN cap ELSE w * max(CASE WHEN NOT cap / w < lev THEN lev END) OVER () END AS target,
         greatest(1, ceil(source_size / 1048576.0))::BIGINT AS shards FROM leveled),
placed AS (SELECT h.*, a.source_size, a.target, h.at % a.shards AS shard FROM hashed h JOIN aimed a ON h.source IS NOT DISTINCT FROM a.source),
shard AS (SELECT source, shard, sum(size)::BIGINT AS len, ceil(sum(size) / 8.0)::BIGINT AS blocks FROM placed GROUP BY source, shard),
total AS (SELECT a.source, a.target, s.blocks, (SELECT floor(sum(source_size) / 8.0::DOUBLE + 0.5)::BIGINT FROM aimed) AS seats
          FROM aimed a JOIN (SELECT source, sum(blocks)::BIGINT AS blocks FROM shard GROUP BY source) s ON a.source IS NOT DISTINCT FROM s.source),
seat AS (SELECT source, seats, target / (2 * j.s + 1) AS q, j.s AS s FROM total, LATERAL (SELECT unnest(range(0, ceil(target / 8.0)::BIGINT + 24)) AS s) j WHERE target > 0),
won AS (SELECT source, count(*) AS n FROM (SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST, s) AS r, seats FROM seat) WHERE r <= seats GROUP BY source),
source_quota AS (SELECT t.source, least(coalesce(w.n, 0), 3 * t.blocks) AS quota FROM total t LEFT JOIN won w ON t.source IS NOT DISTINCT FROM w.source),
shard2 AS (SELECT s.*, q.quota AS source_quota, sum(len) OVER (PARTITION BY s.source) AS all_len FROM shard s JOIN source_quota q ON s.source IS NOT DISTINCT FROM q.source),
seat2 AS (SELECT source, shard, source_quota, len / (2 * j.s + 1) AS q, j.s AS s FROM shard2, LATERAL (SELECT unnest(range(0, ceil(source_quota * len / greatest(all_len, 1)::DOUBLE)::BIGINT + 24)) AS s) j WHERE len > 0),
won2 AS (SELECT source, shard, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard NULLS LAST, s) AS r FROM seat2) WHERE r <= source_quota GROUP BY source, shard),
b1 AS (SELECT s.*, least(coalesce(w.n, 0), 3 * blocks)::BIGINT AS quota, ((s.shard % 2147483647 + 20241) % 2147483647 * 48271 + 12345) % 2147483647 AS a1
       FROM shard2 s LEFT JOIN won2 w ON s.source IS NOT DISTINCT FROM w.source AND s.shard = w.shard),
b2 AS (SELECT *, (((a1 * 48271 + 12345) % 2147483647) * 48271 + 12345) % 2147483647 % greatest(blocks, 1) AS start FROM b1),
stream AS (
  SELECT p.*, b.blocks, b.quota, b.start, (sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY p.at, p.doc_id NULLS LAST, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS fin
  FROM placed p JOIN b2 b ON p.source IS NOT DISTINCT FROM b.source AND p.shard = b.shard),
cut AS (
  SELECT *, CASE WHEN blocks > 0 THEN ((fin // 8) * quota + start) // blocks * 8 + (fin % 8) * (((fin // 8 + 1) * quota + start) // blocks - ((fin // 8) * quota + start) // blocks) END AS c1,
    CASE WHEN blocks > 0 THEN (((fin - size) // 8) * quota + start) // blocks * 8 + ((fin - size) % 8) * ((((fin - size) // 8 + 1) * quota + start) // blocks - (((fin - size) // 8) * quota + start) // blocks) END AS c0
  FROM stream)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 AND blocks > 0 THEN c1 - c0 ELSE 0 END::BIGINT AS taken FROM cut
"""

#: Integer BM25 over every posting of the items' terms.
SEARCH = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
sized AS (SELECT row, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
stats AS (SELECT count(*)::BIGINT AS nd, coalesce(sum(n), 0)::BIGINT AS l FROM sized),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
post AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM item) GROUP BY row, doc_id, n, term),
weight AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS wt FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats),
hit AS (SELECT item_id, row, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
        FROM post JOIN weight USING (term) JOIN item USING (term), stats GROUP BY item_id, row, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM hit WHERE score > 0) WHERE rank <= 10
"""


def centroid_sql(k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3) -> str:
    """Every round written out: all distances to all centroids, then floored means."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, embedding
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        "x AS MATERIALIZED (SELECT row, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS v FROM kept)",
        f"""c0 AS MATERIALIZED (SELECT k, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS v FROM
  (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, embedding) - 1 AS k, v FROM kept) WHERE k < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT row, k, d FROM (SELECT row, k, d, row_number() OVER (PARTITION BY row ORDER BY d, k) AS r FROM
  (SELECT row, k, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c USING (i) GROUP BY row, k)) WHERE r = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT k, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS v FROM
  (SELECT k, i, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM a{r} JOIN x USING (row) GROUP BY k, i)) m ON c.k = m.k AND c.i = m.i)"""
            )
    return f"""WITH {', '.join(parts)},
name AS (SELECT k, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (row) JOIN name USING (k)"""


CLUSTER = centroid_sql()
