"""Severity labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.config import DISTANCE_TESTS, SEVERITIES, DriftConfig, ImageDriftConfig


def severity_rank(label: Column) -> Column:
    """low 0, medium 1, high 2; null for anything else."""
    out = F.lit(None).cast("int")
    for rank, name in enumerate(SEVERITIES):
        out = F.when(label == name, F.lit(rank)).otherwise(out)
    return out


def detected(score: Column, test: Column, threshold: Column) -> Column:
    """A p-value drifts below its threshold, a distance at or above it."""
    return F.when(test.isin(*DISTANCE_TESTS), score >= threshold).otherwise(score < threshold)


def feature_severity(score: Column, is_drifted: Column, test: Column, config: DriftConfig = DriftConfig()) -> Column:
    """Grade of one feature; a distance test is graded upwards, a p-value downwards."""
    by_distance = F.when(score >= config.distance_high, "high").when(score >= config.distance_medium, "medium")
    by_p_value = F.when(score < config.high_below, "high").when(score < config.medium_below, "medium")
    graded = F.when(test.isin(*DISTANCE_TESTS), by_distance.otherwise("low")).otherwise(by_p_value.otherwise("low"))
    return F.when(is_drifted, graded).otherwise("low")


def overall_severity(share: Column, config: DriftConfig = DriftConfig()) -> Column:
    """Grade of a batch from its share of drifted features; the upper edges belong to the lower grade."""
    return F.when(share <= config.low_max, "low").when(share <= config.medium_max, "medium").otherwise("high")


def image_severity(score: Column, config: ImageDriftConfig = ImageDriftConfig()) -> Column:
    return F.when(score >= config.high, "high").when(score >= config.medium, "medium").otherwise("low")


def raises_alert(severity: Column, minimum: str) -> Column:
    """At or above the configured minimum; an unknown label counts as low on either side."""
    floor = SEVERITIES.index(minimum) if minimum in SEVERITIES else 0
    return F.coalesce(severity_rank(severity), F.lit(0)) >= F.lit(floor)


def trips_gate(severity: Column, fail_on: str, interactive: bool = False) -> Column:
    """Whether an unattended run must fail; "never" and unknown labels never trip it."""
    if interactive or fail_on not in SEVERITIES:
        return F.lit(False)
    return F.coalesce(severity_rank(severity) >= F.lit(SEVERITIES.index(fail_on)), F.lit(False))
