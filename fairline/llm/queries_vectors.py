"""Registered queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.centroids import cluster_vectors
from fairline.llm.common import table
from fairline.llm.topk import nearest


def op11_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best other vectors for every vector whose id is divisible by 50."""
    return nearest(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors of 64 components in 16 clusters after three rounds."""
    return cluster_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"), k=16, rounds=3, dims=64)


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_OP11_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE {_USABLE}
),
scored AS (
  SELECT q.n AS qn, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id NULLS LAST) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def _round_sql(n: int) -> str:
    """Assignment to the centroids c{n}, and the centroids after it."""
    return f"""
d{n} AS (
  SELECT v.n, v.vec_id, v.e, c.cluster,
    CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
  FROM v CROSS JOIN c{n} c
),
a{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY distance, cluster) AS r FROM d{n}) WHERE r = 1),
m{n} AS (
  SELECT cluster, i, CAST((s - (((s % many) + many) % many)) // many AS BIGINT) AS x FROM (
    SELECT cluster, i, sum(x) AS s, count(*) AS many FROM (SELECT cluster, unnest(e) AS x, unnest(range(len(e))) AS i FROM a{n}) GROUP BY cluster, i
  )
),
c{n + 1} AS (
  SELECT c.cluster, coalesce(g.e, c.e) AS e FROM c{n} c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS e FROM m{n} GROUP BY cluster) g ON g.cluster = c.cluster
)"""


_OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE {_USABLE} AND len(embedding) = 64
),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY digest, e) - 1 AS INTEGER) AS cluster, e
  FROM (SELECT sha256('1:' || vec_id) AS digest, e FROM v ORDER BY digest, e LIMIT 16)
),
{",".join(_round_sql(n) for n in range(3))},
d AS (
  SELECT v.n, v.vec_id, c.cluster,
    CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
  FROM v CROSS JOIN c3 c
),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY distance, cluster) AS r FROM d) WHERE r = 1)
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a JOIN c3 c ON c.cluster = a.cluster
"""

QUERIES = {
    "op11_exact_topk": (op11_exact_topk, _OP11_SQL),
    "op13_centroid_clustering": (op13_centroid_clustering, _OP13_SQL),
}
