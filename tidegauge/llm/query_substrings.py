from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import query, table
from .fm_dedup import drop_repeats


# No SQL: every 20-word window of whole tables is too much for one; tests/llm/test_fm_dedup.py has the brute force.
@query("op5_fm_substring_dedup")
def op5_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
