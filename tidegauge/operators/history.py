"""Drift history: index rows, latest record, trends and counts per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.severity import severity_rank

TREND_RUNS = 5
WORSENING, IMPROVING, STABLE, TOO_FEW = "WORSENING", "IMPROVING", "STABLE", "insufficient data"


def history_index(results: DataFrame, json_path: Column, run_id: Column | None = None) -> DataFrame:
    """The nine index fields of drift records; a field a record lacks is null."""
    overall = results.schema["overall"].dataType.fieldNames()

    def field(name: str, kind: str) -> Column:
        return (F.col(f"overall.{name}") if name in overall else F.lit(None)).cast(kind)

    version = F.col("dataset_version_id") if "dataset_version_id" in results.columns else F.lit(None).cast("string")
    return results.select(
        F.col("generated_at").alias("timestamp"),
        version.alias("dataset_version_id"),
        "drift_type",
        field("severity", "string").alias("overall_severity"),
        field("drift_share", "double").alias("drift_share"),
        field("drifted_feature_count", "bigint").alias("drifted_feature_count"),
        field("drift_score", "double").alias("drift_score"),
        json_path.alias("json_path"),
        (run_id if run_id is not None else F.lit(None).cast("string")).alias("mlflow_run_id"),
    )


def latest_drift(history: DataFrame, records: DataFrame) -> DataFrame:
    """(model, path, source): the record of the last history line that can be read, else the newest record.

    ``history`` is (model, position, json_path), ``records`` (model, path, modified_at, readable).
    """
    good = records.where("readable").select("model", "path", "modified_at")
    listed = history.join(good.select("model", F.col("path").alias("json_path")), ["model", "json_path"])
    by_line = listed.groupBy("model").agg(F.max_by("json_path", "position").alias("line_path"))
    newest = good.groupBy("model").agg(F.max(F.struct("modified_at", "path")).alias("n"))
    return newest.join(by_line, "model", "left").select(
        "model",
        F.coalesce("line_path", "n.path").alias("path"),
        F.when(F.col("line_path").isNotNull(), "history").otherwise("snapshot").alias("source"),
    )


def summary_rows(results: DataFrame) -> DataFrame:
    """Display rows of records (…, generated_at, drift_score, drift_share, severity, detected, batch_size, row_count).

    A score of 0 gives way to the share, as the summary always did.
    """
    detected = F.when(F.col("detected"), "YES").when(~F.col("detected"), "NO").otherwise("?")
    return results.withColumns(
        {
            "score": F.coalesce(F.nullif("drift_score", F.lit(0.0)), "drift_share"),
            "size": F.coalesce("batch_size", "row_count"),
            "detected_text": detected,
            "severity_text": F.upper(F.coalesce("severity", F.lit("?"))),
        }
    )


def last_runs(results: DataFrame, keys: list[str], at: str, n: int, tie: str) -> DataFrame:
    """The last ``n`` rows per key; Spark keeps n rows per key and task before it sorts."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return results.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def severity_trend(results: DataFrame, keys: list[str], at: str, tie: str, severity: str = "severity") -> DataFrame:
    """(keys…, runs, trend) over the last five runs; an unknown severity counts as low."""
    rank = F.coalesce(severity_rank(F.col(severity)), F.lit(0))
    recent = last_runs(results, keys, at, TREND_RUNS, tie).withColumn("_r", rank)
    ends = recent.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.min(F.struct(at, tie, "_r")).alias("first"),
        F.max(F.struct(at, tie, "_r")).alias("last"),
    )
    first, last = F.col("first._r"), F.col("last._r")
    trend = F.when(F.col("runs") < 2, TOO_FEW).when(last > first, WORSENING).when(last < first, IMPROVING).otherwise(STABLE)
    return ends.select(*keys, "runs", trend.alias("trend"))


def summary_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, runs, drifted, percent, high, medium, low): whole percent; everything not high or medium is low."""
    out = results.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.count_if("detected").alias("drifted"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
    )
    return out.withColumns(
        {
            "percent": F.floor(F.lit(100) * F.col("drifted") / F.col("runs")).cast("bigint"),
            "low": F.col("runs") - F.col("high") - F.col("medium"),
        }
    )


def attempts(manifests: DataFrame, keys: list[str]) -> DataFrame:
    """Readable manifests (keys…, attempt_id, created_at, …) with ``is_latest``, the one of the largest id."""
    top = manifests.where("readable").groupBy(*keys).agg(F.max("attempt_id").alias("_top"))
    rows = manifests.where("readable").join(top, keys)
    return rows.withColumn("is_latest", F.col("attempt_id") == F.col("_top")).drop("_top", "readable")
