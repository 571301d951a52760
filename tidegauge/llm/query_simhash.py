from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .simhash_vp import near_groups


# No SQL: DuckDB has no XXH64 with a seed and no cheap closure. tests/llm/test_simhash.py has the brute force.
@query("op6_simhash_vp_groups")
def op6_simhash_vp_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
