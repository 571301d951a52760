"""Drift monitoring end to end: size gate, alignment, tests, grades, record, alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import DriftConfig, ImageDriftConfig
from tidegauge.operators import image_drift as im
from tidegauge.operators.drift_report import (
    batch_sizes,
    large_enough,
    require_alignment,
    result_records,
    scored_grid,
    with_alerts,
    with_verdict,
)
from tidegauge.operators.mmd import embedding_mmd
from tidegauge.operators.two_sample import BATCH


def monitor_features(
    reference: DataFrame, batches: DataFrame, features: list[str], batch: str, config: DriftConfig = DriftConfig()
) -> DataFrame:
    """One row per (batch, feature) for every batch that is large enough, with the batch's own verdict."""
    require_alignment(reference, batches, features, (batch,))
    table = scored_grid(reference, batches, features, batch, config, config.min_batch_size)
    return with_verdict(table.drop("row_count", "is_infinite"), config)


def monitor(
    reference: DataFrame,
    batches: DataFrame,
    features: list[str],
    batch: str,
    config: DriftConfig = DriftConfig(),
    task_type: str = "classification",
    interactive: bool = False,
    generated_at: Column | None = None,
) -> DataFrame:
    """One nested drift record per batch, with the alert and the gate. Batches below the minimum size give none."""
    require_alignment(reference, batches, features, (batch,))
    table = scored_grid(reference, batches, features, batch, config, config.min_batch_size)
    records = result_records(table, reference, config, task_type, generated_at=generated_at)
    graded = records.withColumn("severity", F.col("overall.severity"))
    return with_alerts(graded, config, interactive).drop("severity")


def monitor_images(
    reference: DataFrame,
    batches: DataFrame,
    batch: str,
    config: ImageDriftConfig = ImageDriftConfig(),
    signatures: DataFrame | None = None,
    report: DataFrame | None = None,
    generated_at: Column | None = None,
) -> DataFrame:
    """One nested record per image batch from channel distances, with scale profile and nearest scenario."""
    kept = large_enough(batches, batch, config.min_batch_size)
    sizes = batch_sizes(batches, batch).where(F.col("row_count") >= config.min_batch_size)
    channels = im.channel_wasserstein(reference, kept, batch)
    profile = im.scale_profile(im.multiscale(reference, kept, batch, config))
    rows = im.channel_summary(channels, config).join(sizes, BATCH).join(profile, BATCH, "left")
    if signatures is not None:
        match = im.match_scenarios(channels, signatures, report, config)
        found = F.struct(*[c for c in match.columns if c != BATCH]).alias("scenario_interpretation")
        rows = rows.join(match.select(BATCH, found), BATCH, "left")
    size = reference.agg(F.count("*")).scalar()
    return im.image_records(rows, size, "statistical", generated_at=generated_at, config=config)


def monitor_embeddings(
    reference: DataFrame,
    batch_rows: DataFrame,
    name: str,
    vector: str,
    config: ImageDriftConfig = ImageDriftConfig(),
    generated_at: Column | None = None,
) -> DataFrame:
    """The record of one batch from the MMD of its embeddings; an empty table where the batch is too small."""
    score = embedding_mmd(reference, batch_rows, vector).where(F.col("m") >= config.min_batch_size)
    rows = score.select(F.lit(name).alias(BATCH), F.col("mmd").alias("drift_score"), F.col("m").alias("row_count"), "n")
    return im.image_records(rows, F.col("n"), "embedding", generated_at=generated_at, config=config)
