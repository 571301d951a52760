"""Data contracts: schema, size, null, label and class-count checks as tables of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.config import DataContract
from tidegauge.functions.columns import no_nan, ratio

DECLARED_TYPES = {"float": "double", "int": "bigint", "string": "string", "bool": "boolean"}
MESSAGE_VALUES = 50  # how many labels a raised message spells out; the table has them all


def declared_type(dtype: T.DataType) -> str:
    """The contract's word for a column type; anything unusual is a string."""
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.IntegralType):
        return "int"
    return "bool" if isinstance(dtype, T.BooleanType) else "string"


def column_findings(df: DataFrame, contract: DataContract) -> list[tuple[str, str, str]]:
    """(level, check, column): a missing column is an error, an extra one a warning. Schema only."""
    have, want = set(df.columns), set(contract.types) | {contract.target}
    out = [("error", "missing_column", c) for c in sorted(want - have)]
    return out + [("warning", "extra_column", c) for c in sorted(have - want)]


def column_table(df: DataFrame, contract: DataContract) -> DataFrame:
    return df.sparkSession.createDataFrame(
        column_findings(df, contract), "level string, check string, `column` string"
    )


def dtype_findings(df: DataFrame, contract: DataContract) -> list[tuple[str, str, str, bool]]:
    """(column, declared, actual, ok) of typed columns; columns of unknown declared types are skipped."""
    return [
        (c, declared, declared_type(df.schema[c].dataType), declared_type(df.schema[c].dataType) == declared)
        for c, declared in contract.types.items()
        if c in df.columns and declared in DECLARED_TYPES
    ]


def text_dtype_table(df: DataFrame, contract: DataContract) -> DataFrame:
    """For untyped text: per column how many non-null values do not read as the declared type. One pass."""
    checked = [(c, t) for c, t in contract.types.items() if c in df.columns and t in DECLARED_TYPES]
    bad = [
        F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(DECLARED_TYPES[t]).isNull()).alias(f"b{i}")
        for i, (c, t) in enumerate(checked)
    ]
    pairs = [x for i, (c, t) in enumerate(checked) for x in (F.lit(c), F.lit(t), F.col(f"b{i}"))]
    out = df.agg(*bad).select(F.stack(F.lit(len(checked)), *pairs).alias("column", "declared", "bad_values"))
    return out.withColumn("ok", F.col("bad_values") == 0)


def row_count_check(df: DataFrame, contract: DataContract, by: str | None = None) -> DataFrame:
    """(split, observed, limit, ok) for the minimum number of rows.

    An empty table has a count, and with ``by`` so has every split that the contract expects and the table lacks.
    """
    count = F.count("*").alias("observed")
    if by is None:
        counted = df.agg(count).withColumn("split", F.lit("all"))
    else:
        counted = df.groupBy(F.col(by).cast("string").alias("split")).agg(count)
        wanted = df.sparkSession.createDataFrame([(s,) for s in contract.splits], "split string")
        counted = counted.join(F.broadcast(wanted), "split", "full").withColumn("observed", F.coalesce("observed", F.lit(0).cast("bigint")))
    return (
        counted.select("split", "observed", F.lit(contract.min_rows).cast("bigint").alias("limit"), (F.col("observed") >= contract.min_rows).alias("ok"))
    )


def _split(by: str | None) -> Column:
    return F.lit("all") if by is None else F.col(by)


def null_fractions(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(split, column, nulls, rows, fraction) from one pass over all columns."""
    nulls = [F.count_if(no_nan(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    pairs = [x for i, c in enumerate(columns) for x in (F.lit(c), F.col(f"n{i}"))]
    wide = df.groupBy(_split(by).alias("split")).agg(F.count("*").alias("rows"), *nulls)
    long = wide.select("split", F.stack(F.lit(len(columns)), *pairs).alias("column", "nulls"), "rows")
    return long.withColumn("fraction", ratio(F.col("nulls"), F.col("rows")))


def null_fraction_check(df: DataFrame, contract: DataContract, by: str | None = None) -> DataFrame:
    columns = [c for c in df.columns if c != by]
    return null_fractions(df, columns, by).withColumn("ok", F.col("fraction") <= contract.max_null_fraction)


def null_fail_fast(df: DataFrame, features: list[str]) -> DataFrame:
    """(column, nulls) of the features that have any; empty means the data may pass."""
    return null_fractions(df, features).where("nulls > 0").select("column", "nulls")


def unknown_labels(df: DataFrame, contract: DataContract, by: str | None = None) -> DataFrame:
    """(split, label) of non-null target values outside the contract's classes; none for regression."""
    if contract.target not in df.columns:  # the schema findings name it
        return df.select(_split(by).alias("split"), F.lit(None).cast("string").alias("label")).where(F.lit(False))
    found = df.where(F.col(contract.target).isNotNull()).select(
        _split(by).alias("split"), F.col(contract.target).cast("string").alias("label")
    )
    if contract.task_type == "regression" or not contract.label_classes:
        return found.where(F.lit(False))
    return found.where(~F.col("label").isin(*contract.label_classes)).distinct()


def contract_report(df: DataFrame, contract: DataContract, by: str | None = None) -> DataFrame:
    """All checks as (split, check, column, observed, limit, ok); ``by`` names the split column."""
    spark: SparkSession = df.sparkSession
    shape = "split string, check string, `column` string, observed double, limit double, ok boolean"
    schema_rows = [
        ("all", check, c, 1.0, 0.0, level != "error") for level, check, c in column_findings(df.drop(by) if by else df, contract)
    ] + [("all", "dtype", c, float(not ok), 0.0, ok) for c, _, _, ok in dtype_findings(df, contract)]
    columns = [c for c in df.columns if c != by]
    nulls = null_fractions(df, columns, by)
    rows = row_count_check(df, contract, by)
    labels = unknown_labels(df, contract, by).groupBy("split").agg(F.count("*").alias("n"))
    parts = [
        spark.createDataFrame(schema_rows, shape),
        rows.select(
            "split",
            F.lit("min_rows").alias("check"),
            F.lit(None).cast("string").alias("column"),
            F.col("observed").cast("double"),
            F.col("limit").cast("double"),
            "ok",
        ),
        nulls.select(
            "split",
            F.lit("null_fraction").alias("check"),
            "column",
            F.col("fraction").alias("observed"),
            F.lit(float(contract.max_null_fraction)).alias("limit"),
            (F.col("fraction") <= contract.max_null_fraction).alias("ok"),
        ),
        labels.select(
            "split",
            F.lit("unknown_labels").alias("check"),
            F.lit(contract.target).alias("column"),
            F.col("n").cast("double").alias("observed"),
            F.lit(0.0).alias("limit"),
            F.lit(False).alias("ok"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assert_contract(df: DataFrame, contract: DataContract, by: str | None = None) -> None:
    """Raise one error with every violated check. The report has a few rows per column and split."""
    failed = contract_report(df, contract, by).where(~F.col("ok")).collect()
    if not failed:
        return
    lines = [f"[{r['split']}] {r['check']} {r['column'] or ''}: {r['observed']:g} against {r['limit']:g}" for r in failed]
    if any(r["check"] == "unknown_labels" for r in failed):
        some = unknown_labels(df, contract, by).select("label").distinct().orderBy("label").limit(MESSAGE_VALUES)
        lines.append("unknown labels: " + ", ".join(r["label"] for r in some.collect()))
    raise ValueError("data contract failed:\n  " + "\n  ".join(sorted(lines)))


def class_counts(listing: DataFrame, contract: DataContract) -> DataFrame:
    """(label, n, limit, ok) of an image listing (path, label): every class of the contract, zeros included."""
    spark = listing.sparkSession
    suffixes = [f.lower() for f in contract.expected_formats]
    allowed = listing.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))
    counted = allowed.groupBy("label").agg(F.count("*").alias("n"))
    classes = spark.createDataFrame([(c,) for c in contract.label_classes], "label string")
    least = F.lit(contract.min_images_per_class).cast("bigint")
    return classes.join(counted, "label", "left").select(
        "label", F.coalesce("n", F.lit(0)).alias("n"), least.alias("limit"), (F.coalesce("n", F.lit(0)) >= least).alias("ok")
    )


def infer_columns(df: DataFrame, target: str) -> list[tuple[str, str, str]]:
    """(column, type, role) read from the schema."""
    return [(f.name, declared_type(f.dataType), "target" if f.name == target else "feature") for f in df.schema.fields]


def infer_contract(df: DataFrame, name: str, target: str, task_type: str = "classification") -> DataContract:
    """A contract that the data fulfils: its types, the default limits, and its sorted classes.

    The classes are part of the contract object, so a target with very many values is refused.
    """
    types = {c: t for c, t, _ in infer_columns(df, target)}
    classes: tuple[str, ...] = ()
    if task_type == "classification":
        labels = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("v")).distinct()
        found = [r["v"] for r in labels.limit(MAX_CLASSES + 1).collect()]
        if len(found) > MAX_CLASSES:
            raise ValueError(f"target {target} has more than {MAX_CLASSES} classes; it is not a class label")
        classes = tuple(sorted(found))
    return DataContract(name, target, types, task_type, label_classes=classes)


MAX_CLASSES = 10_000


def infer_table(df: DataFrame, target: str) -> DataFrame:
    """The inferred contract as rows (column, type, role, label_class): one per feature, one per target class."""
    spark = df.sparkSession
    listed = infer_columns(df, target)
    features = spark.createDataFrame([r for r in listed if r[2] == "feature"], "`column` string, type string, role string")
    kind = next(t for c, t, _ in listed if c == target)
    classes = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("label_class")).distinct()
    return features.withColumn("label_class", F.lit(None).cast("string")).unionByName(
        classes.select(F.lit(target).alias("column"), F.lit(kind).alias("type"), F.lit("target").alias("role"), "label_class")
    )


def unknown_classes(rows: DataFrame, label: str, known: DataFrame, known_label: str) -> DataFrame:
    """(label, n): labels of a new batch, with their row counts, that the known class table lacks."""
    seen = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return seen.join(known.select(F.col(known_label).alias("label")).distinct(), "label", "left_anti")


def batch_readiness(df: DataFrame, inputs: list[str], target: str, minimum: int = 2) -> DataFrame:
    """(check, column, ok) of a labelled batch: every input and the target present, enough rows."""
    spark = df.sparkSession
    rows = [("column", c, c in df.columns) for c in [*inputs, target]]
    columns = spark.createDataFrame(rows, "check string, `column` string, ok boolean")
    size = df.agg(F.count("*").alias("n")).select(
        F.lit("rows").alias("check"), F.lit(None).cast("string").alias("column"), (F.col("n") >= minimum).alias("ok")
    )
    return columns.unionByName(size)
