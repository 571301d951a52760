"""Records as long metric rows and as JSON that any reader accepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.columns import finite, is_float


def _rows(df: DataFrame, keys: list[str], entries: Column) -> DataFrame:
    long = df.select(*keys, F.explode(entries).alias("key", "value"))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def evaluation_rows(reports: DataFrame, keys: list[str], metrics: str = "metrics") -> DataFrame:
    """``eval.<metric>`` rows of a map of metrics; a value that is no number has no row."""
    named = F.transform_keys(F.col(metrics), lambda k, v: F.concat(F.lit("eval."), k))
    return _rows(reports, keys, F.transform_values(named, lambda k, v: v.cast("double")))


def comparison_rows(comparison: DataFrame, keys: list[str]) -> DataFrame:
    """``comparison.delta.<metric>`` rows of compared models."""
    return comparison.where(F.col("delta").isNotNull()).select(
        *keys, F.concat(F.lit("comparison.delta."), "metric").alias("key"), F.col("delta").alias("value")
    )


def drift_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """``drift.<feature>.score`` rows of tabular drift records."""
    scores = F.transform_values("features", lambda k, v: v["drift_score"])
    return _rows(records, keys, F.transform_keys(scores, lambda k, v: F.concat(F.lit("drift."), k, F.lit(".score"))))


def image_drift_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """``drift.image.overall_score`` and ``drift.image.<channel>_score`` rows, with the accuracy drop of a match."""
    overall = records.select(
        *keys, F.lit("drift.image.overall_score").alias("key"), F.col("overall.drift_score").alias("value")
    )
    scores = F.transform_values("channels", lambda k, v: v["drift_score"])
    named = F.transform_keys(scores, lambda k, v: F.concat(F.lit("drift.image."), k, F.lit("_score")))
    out = overall.where(F.col("value").isNotNull()).unionByName(_rows(records, keys, named))
    match = records.schema["scenario_interpretation"].dataType if "scenario_interpretation" in records.columns else None
    if isinstance(match, T.StructType):
        drop = F.col("scenario_interpretation.estimated_accuracy_drop").alias("value")
        extra = records.select(*keys, F.lit("drift.image.estimated_accuracy_drop").alias("key"), drop)
        out = out.unionByName(extra.where(F.col("value").isNotNull()))
    return out


def drift_tags(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, tags): the text tags of a drift record."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    flag = F.when(F.col("overall.dataset_drift_detected"), "true").otherwise("false")
    pairs = [
        F.lit("drift.type"), text("drift_type"),
        F.lit("drift.overall_severity"), text("overall.severity"),
        F.lit("drift.dataset_drift_detected"), flag,
        F.lit("drift.drift_share"), text("overall.drift_share"),
        F.lit("drift.drifted_feature_count"), text("overall.drifted_feature_count"),
    ]
    return records.select(*keys, F.create_map(*pairs).alias("tags"))


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def _safe(c: Column, kind: T.DataType) -> Column:
    if is_float(kind):
        return finite(c)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        valued = F.transform_values(c, lambda k, v: _safe(v, kind.valueType))
        if isinstance(kind.keyType, T.StringType):
            return valued
        return F.transform_keys(valued, lambda k, v: k.cast("string"))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities as null at any depth, map keys as text."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def json_records(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON text, nulls written out."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))
