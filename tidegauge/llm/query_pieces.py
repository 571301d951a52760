from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import query, table
from .piece_lattice import Pieces, totals


# No SQL: the Viterbi fold has no twin there. tests/llm/test_pieces.py compares with the library's own search.
@query("op2_sentencepiece_lattice")
def op2_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return totals(table(spark, sf_dir, "documents"), pieces)
