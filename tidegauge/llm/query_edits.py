from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .edit_counts import edited_counts

# A revision of each document: a passage replaced, a word put in, a span cut out, the source named at the end.
REVISION = """array(
  struct(length(text) div 3 AS at, 24 AS cut, substring(text, 1, 40) AS put),
  struct(length(text) div 2 AS at, 0 AS cut, concat(' ', coalesce(lang, ''), '\\'ll ') AS put),
  struct(length(text) div 5 AS at, 60 AS cut, '' AS put),
  struct(CAST(null AS INT) AS at, 0 AS cut, concat('\\n', coalesce(source, '')) AS put))
"""


# No SQL: tests/llm/test_edits.py counts every edited text from the start.
@query("op10_edit_aware_counts")
def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return edited_counts(docs, F.expr(REVISION), path, public_tokenizers.PATTERN)
