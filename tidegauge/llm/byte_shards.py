"""Contiguous shards of nearly equal bytes, from prefix sums over the totals of range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_parts

# Rows of (id, size, checksum) that one range partition holds; they are a few dozen bytes each.
ROWS_PER_PART = 1_000_000
ROW_OVERHEAD = 16


def byte_shards(df: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal all rows to shards 0 to ``shards - 1`` in order of ``key``, with nearly equal bytes in each.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; a null text has none), text_crc32, shard and slot (from 0
    within the shard, without gaps). A row goes where the middle of its bytes falls, so a shard is off the mean by
    less than the largest row, and a row larger than a shard leaves a neighbour empty.

    Rows are ranged by (key, size, checksum, input position), so a null or much repeated key is split like any other;
    null keys come first. One row per partition carries its totals; prefix sums over those give each partition its
    start, and no task sees more than a partition. Other columns are ignored. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = checkpointed(
        df.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
        )
    )
    spark = df.sparkSession
    parts = max(shuffle_parts(spark), -(-rows.count() // ROWS_PER_PART))
    order = ["doc_id", "size", "text_crc32", "tie"]
    # The bounds of the ranges are drawn once: what follows reads them from the checkpoint.
    ranged = checkpointed(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("size_before"),
            F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("part_size").over(everything).alias("total"),
        )
    )
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    middle = F.expr("size_before + coalesce(size_here, 0L) + size div 2").cast("decimal(38,0)")
    placed = (
        ranged.withColumn("size_here", F.sum("size").over(here))
        .withColumn("row_here", F.count(F.lit(1)).over(here))
        .join(totals, "part")
        .withColumn("shard", F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1)).cast("int"))
        .withColumn("row", F.col("rows_before") + F.col("row_here"))
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )
