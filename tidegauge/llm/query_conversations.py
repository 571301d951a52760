from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .conversation_repair import digests, repaired_blocks


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with a fifth of the rows damaged by crc32(conv_id:turn) % 20, nulls as one space.

    0 drops the row (it stays with ``present`` false, to name its conversation), 1 empties the text, 2 takes its
    ``[.!?]`` out, 3 repeats the row, 4 makes the role ``user``.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.withColumn("harm", F.crc32(key.cast("binary")) % 20)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("harm") != 0).alias("present"),
        F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


# No SQL: DuckDB has no CRC-32. tests/llm/test_conversations.py has the brute force.
@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = repaired_blocks(damaged(table(spark, sf_dir, "conversations")), present="present")
    return digests(blocks).withColumnRenamed("conv", "conv_id")
