from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .language_id import fit_profiles, predict


# No SQL: tests/llm/test_language.py has the brute force and the held-out accuracy.
@query("op4_rank_order_language")
def op4_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    profiles = fit_profiles(docs.where(~held))
    return predict(docs, profiles).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
