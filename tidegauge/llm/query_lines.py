from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .line_dedup import drop_site_lines

# Both engines' trim takes spaces only.
LINES_SQL = """
WITH lines AS (
  SELECT source, list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x))) AS own
  FROM documents WHERE source IS NOT NULL),
totals AS (SELECT source, count(*) AS pages FROM lines GROUP BY source),
counts AS (
  SELECT source, line, count(*) AS n
  FROM (SELECT source, unnest(own) AS line FROM lines WHERE own IS NOT NULL) GROUP BY source, line),
dropped AS (
  SELECT source, list(line) AS gone FROM counts JOIN totals USING (source)
  WHERE line <> '' AND n >= 5 AND n > 0.1 * pages GROUP BY source),
kept AS (
  SELECT d.doc_id, string_split(d.text, chr(10)) AS old,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(b.gone, []), trim(x))) AS new
  FROM documents d LEFT JOIN dropped b ON d.source = b.source)
SELECT doc_id, CAST(len(old) AS BIGINT) AS n_lines, CAST(len(old) - len(new) AS BIGINT) AS n_dropped,
  sha256(array_to_string(new, chr(10))) AS kept_sha256
FROM kept
"""


@query("op9_site_line_dedup", LINES_SQL)
def op9_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` is the site of a document."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines")
    )
    return drop_site_lines(docs, dropped="n_dropped").select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
