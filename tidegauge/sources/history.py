"""The drift history on storage: index lines and full records as JSON, in folders by model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_SCHEMA = (
    "timestamp timestamp, dataset_version_id string, drift_type string, overall_severity string, drift_share double, "
    "drifted_feature_count long, drift_score double, json_path string, mlflow_run_id string"
)
OVERALL = "struct<dataset_drift_detected:boolean,drift_score:double,drift_share:double,drifted_feature_count:long,total_feature_count:long,severity:string>"
RESULT_SCHEMA = (
    f"generated_at string, drift_type string, method string, dataset_version_id string, overall {OVERALL}, "
    "current_dataset struct<source:string,row_count:long>, batch struct<size:long>"
)
CORRUPT = "_corrupt_record"
MODEL_FOLDERS, SHARED_FOLDERS = 200, 64  # models of one append with a folder each, and the folders for more
SHARED, NAME = "_shared-", "_name"  # a shared folder's name begins so, and a line's field for its model ends so
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def append_history(index: DataFrame, root: str, model: str) -> None:
    """Append index rows; ``model`` is the column with the model's name. Earlier lines are never rewritten.

    Rows are gathered by folder before they are written, so files grow with the rows and not with tasks x models; a busy
    model's rows may be split over several tasks. Up to MODEL_FOLDERS models (counted) have a folder each. The rows of more
    are dealt over SHARED_FOLDERS folders by a hash of the model, whose lines carry the name.
    """
    folder = F.col(model)
    if index.select(model).distinct().count() > MODEL_FOLDERS:
        part = F.pmod(F.xxhash64(model), F.lit(SHARED_FOLDERS)).cast("string")
        folder = F.when(folder.isNotNull(), F.concat(F.lit(SHARED), part))
    rows = index.withColumn(model + NAME, F.col(model).cast("string")).withColumn(model, folder)
    writer = rows.hint("rebalance", F.col(model)).write.mode("append").partitionBy(model)
    writer.option("timestampFormat", STAMP).json(root)


def scan_history(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected): parsed index lines, and the lines that do not parse. A rejected line of a shared folder has
    no model."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "timestampFormat": STAMP}
    lines = spark.read.text(root).where(F.trim("value") != "")
    # only folders read as text can be shared ones or have names that a folder's type could not hold
    kinds = {f.name: f.dataType for f in lines.schema.fields if f.name != "value"}
    named = [c for c, kind in kinds.items() if isinstance(kind, T.StringType)]
    schema = ", ".join([INDEX_SCHEMA, *[f"`{c + NAME}` string" for c in named], f"{CORRUPT} string"])
    parsed = lines.withColumn("_entry", F.from_json("value", schema, options))
    broken = F.col(f"_entry.{CORRUPT}").isNotNull()
    models = [F.coalesce(F.col("_entry")[c + NAME], c).alias(c) if c in named else F.col(c) for c in kinds]
    entries = parsed.where(~broken).select("_entry.*", *models).drop(CORRUPT, *[c + NAME for c in named])
    own = [F.when(~F.startswith(c, F.lit(SHARED)), F.col(c)).alias(c) if c in named else F.col(c) for c in kinds]
    return entries, parsed.where(broken).select("value", *own)


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Full records of a folder in order of time: decision files and records without a verdict are left out."""
    rows = (
        spark.read.schema(f"{RESULT_SCHEMA}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    )
    kept = rows.where(~F.endswith("source_file", F.lit("_decision.json")) & F.col("overall").isNotNull())
    return kept.drop(CORRUPT).withColumn("order_key", F.coalesce("generated_at", "source_file"))
