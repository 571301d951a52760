from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .mixing import with_copies

# Sources in the order of size over weight: those before the first that a common level does not overfill stop at three
# times their size. 10 / weight is whole, so the order is exact.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
weighted AS (
  SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM totals),
ordered AS (
  SELECT *, row_number() OVER o AS place, sum(s) OVER o - s AS s_before, sum(w) OVER () - (sum(w) OVER o - w) AS w_rest,
    sum(s) OVER () AS total
  FROM weighted WINDOW o AS (ORDER BY s * (10 // w), source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT place, total - 3 * s_before AS rest, w_rest FROM ordered
  WHERE w * (total - 3 * s_before) <= 3 * s * w_rest ORDER BY place LIMIT 1),
targets AS (
  SELECT o.source, o.s, CASE WHEN o.place < l.place THEN CAST(3 * o.s AS DOUBLE)
    ELSE CAST(l.rest AS DOUBLE) * CAST(o.w AS DOUBLE) / CAST(l.w_rest AS DOUBLE) END AS target
  FROM ordered o, level l),
rates AS (
  SELECT d.doc_id, d.size, t.s, t.target, CASE WHEN t.s = 0 THEN 0.0 ELSE t.target / t.s END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'text:' || d.text, '')), 1, 13) AS BIGINT) AS DOUBLE)
      / 4503599627370496.0 AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s AS source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rates
"""


@query("op12_weighted_mix", MIX_SQL)
def op12_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
