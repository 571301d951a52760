from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .rotated_clusters import cluster, with_inertia

K, ROUNDS = 8, 10

_START = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
centres0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM kept QUALIFY cluster < 8)"""
_ASSIGN = """,
near{n} AS MATERIALIZED (
  SELECT row, vec_id, v, cluster, distance FROM (
    SELECT row, vec_id, v, cluster,
      CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM kept, centres{n})
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)"""
# Rounds down for negative sums too.
_MOVE = """,
sums{n} AS MATERIALIZED (
  SELECT cluster, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS m
  FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS place FROM near{p}) GROUP BY cluster, place),
centres{n} AS MATERIALIZED (
  SELECT o.cluster, coalesce(any_value(g.c), any_value(o.c)) AS c FROM centres{p} o LEFT JOIN (
    SELECT cluster, list((s - ((s % m) + m) % m) // m ORDER BY place) AS c FROM sums{n} GROUP BY cluster) g USING (cluster)
  GROUP BY o.cluster)"""
_END = """
SELECT a.vec_id, a.cluster, a.distance,
  CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(z.c, ',')) AS centroid_sha256
FROM near{n} a JOIN centres{n} z USING (cluster)"""
CLUSTERS_SQL = (
    _START
    + _ASSIGN.format(n=0)
    + "".join(_MOVE.format(n=n, p=n - 1) + _ASSIGN.format(n=n) for n in range(1, ROUNDS + 1))
    + _END.format(n=ROUNDS)
)


@query("op13_rotated_centroids", CLUSTERS_SQL)
def op13_rotated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums beyond a long, which only components near the limit can reach, are null."""
    rows = with_inertia(*cluster(table(spark, sf_dir, "embeddings"), k=K, rounds=ROUNDS, seed="3"))
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        F.col("cluster_inertia").try_cast("long").alias("cluster_inertia"),
        F.col("inertia").try_cast("long").alias("inertia"),
        F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"),
    )
