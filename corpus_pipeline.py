"""The corpus pipeline: language, site lines, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.fm_dedup import without_repeats
from tidegauge.llm.language_id import UNKNOWN, fit_profiles, prediction
from tidegauge.llm.line_dedup import drop_site_lines
from tidegauge.llm.packing import pack
from tidegauge.llm.simhash_vp import similar_groups

NEAR_WORDS = 5
NEAR_SIMILARITY = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: those without a letter, whether or not a language could be learned."""
    profiles = fit_profiles(docs) or {"": {}}  # without labels every letter is of one nameless language
    return docs.where(prediction(F.col("text"), profiles, spark)["lang_pred"] != UNKNOWN).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the boilerplate lines of each source out of its documents; all documents stay."""
    return drop_site_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near copies, and of repeated rows one.

    Rows without a doc_id cannot be named, so they stay.
    """
    groups = similar_groups(docs, shingle=NEAR_WORDS, similarity=NEAR_SIMILARITY)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the words of 20-word windows that start earlier; a document touched keeps its words, one space apart."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), tokens=1024, segments=256, loss=1024)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

# Profiles, fingerprints and byte-pair ids are not for SQL: tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is kept in the shared checkpoint folder."""
    from tidegauge.llm.common import shared_folder

    base = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}-{name}")
        docs = spark.read.parquet(f"{base}/{number}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
