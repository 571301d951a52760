from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import query, table
from .packing import pack


# No SQL: tests/llm/test_packing.py checks every piece against the tokenizer.
@query("op7_vector_packing")
def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), tokens=1024, segments=256, loss=1024)
