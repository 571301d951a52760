"""Tabular sources and sinks: contract scans, versioned splits, tensors and fitted artefacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.config import DataContract
from tidegauge.operators.contract import DECLARED_TYPES
from tidegauge.operators.features import FittedFeatures

_TYPES = {"float": T.DoubleType(), "int": T.LongType(), "string": T.StringType(), "bool": T.BooleanType()}


def contract_schema(contract: DataContract) -> T.StructType:
    return T.StructType([T.StructField(c, _TYPES.get(t, T.StringType())) for c, t in contract.types.items()])


def scan_dataset(spark: SparkSession, path: str, contract: DataContract | None = None, fmt: str | None = None) -> DataFrame:
    """Read a split or batch; CSV by the contract's types (no inference pass), Parquet and ORC by their own."""
    kind = fmt or next((f for f in ("csv", "json", "orc") if path.rstrip("/").endswith(f".{f}")), "parquet")
    if kind == "csv":
        reader = spark.read.option("header", "true")
        if contract is None:
            return reader.csv(path)
        # read as text in header order, then cast by name: a file may order its columns differently
        text = reader.csv(path)
        known = {c: DECLARED_TYPES.get(t, "string") for c, t in contract.types.items() if c in text.columns}
        return text.select(*[F.col(c).try_cast(known.get(c, "string")).alias(c) for c in text.columns])
    if kind == "json":
        reader = spark.read.schema(contract_schema(contract)) if contract else spark.read
        return reader.json(path)
    return spark.read.format(kind).load(path)


def write_split(df: DataFrame, root: str, dataset: str, version: str, split: str) -> None:
    """One partition of the table of all splits; writing it again replaces just that partition."""
    marked = df.withColumns({"dataset": F.lit(dataset), "version": F.lit(version), "split": F.lit(split)})
    writer = marked.write.partitionBy("dataset", "version", "split").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(f"{root}/splits")


def write_feature_map(spark: SparkSession, root: str, dataset: str, version: str, feature_map: dict) -> None:
    row = [(dataset, version, json.dumps(feature_map, sort_keys=True))]
    spark.createDataFrame(row, "dataset string, version string, feature_map string").write.mode("append").json(
        f"{root}/feature_maps"
    )


def scan_reference(spark: SparkSession, root: str, dataset: str, version: str, split: str = "train") -> tuple[DataFrame, dict]:
    """The reference split (a partition-pruned scan) and its feature map; an error names what is missing."""
    maps = spark.read.schema("dataset string, version string, feature_map string").json(f"{root}/feature_maps")
    found = maps.where((F.col("dataset") == dataset) & (F.col("version") == version)).limit(1).collect()
    if not found:
        raise FileNotFoundError(f"no feature map for {dataset} {version}")
    rows = spark.read.option("recursiveFileLookup", "false").parquet(f"{root}/splits")
    rows = rows.where(
        (F.col("dataset") == dataset) & (F.col("version").cast("string") == version) & (F.col("split") == split)
    ).drop("dataset", "version", "split")
    if rows.isEmpty():
        raise FileNotFoundError(f"no {split} split for {dataset} {version}")
    return rows, json.loads(found[0]["feature_map"])


def select_version(table: DataFrame, **keys: str) -> DataFrame:
    """The rows of one (dataset, version, split) of a table that holds many; the filters reach the scan."""
    out = table
    for column, value in keys.items():
        out = out.where(F.col(column) == value)
    return out


def write_tensors(df: DataFrame, path: str, version: str) -> None:
    """Arrays, labels and drift flags as Parquet with the version beside them."""
    df.withColumn("version_id", F.lit(version)).write.mode("overwrite").parquet(path)


def read_tensors(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if version is None else rows.where(F.col("version_id") == version)


def write_fit(spark: SparkSession, fitted: FittedFeatures, path: str) -> None:
    """A fitted preparation as one JSON record, with the feature map other steps read."""
    row = [(json.dumps(fitted.to_dict()), json.dumps(fitted.feature_map()))]
    spark.createDataFrame(row, "fit string, feature_map string").coalesce(1).write.mode("overwrite").json(path)


def read_fit(spark: SparkSession, path: str) -> FittedFeatures:
    row = spark.read.schema("fit string, feature_map string").json(path).first()
    return FittedFeatures(**json.loads(row["fit"]))
