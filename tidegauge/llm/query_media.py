from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .media import read_media, with_media


# No SQL for JPEG: tests/llm/test_media.py has the round trip and an independent decoder.
@query("op1_progressive_jpeg")
def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_media(with_media(table(spark, sf_dir, "documents")))
    pixels = F.col("width").cast("long") * F.col("height")
    means = [F.format_string("%.4f", F.col("sums")[i] / pixels) for i in range(3)]
    size = F.concat_ws("x", F.col("height").cast("string"), F.col("width").cast("string"), F.lit("3"))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", size, *means, F.hex(F.crc32("rgb"))).alias("feature"),
    )
