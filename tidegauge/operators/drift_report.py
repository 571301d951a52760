"""From test scores to a graded drift record per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.config import RECORD_VERSION, DriftConfig
from tidegauge.functions.columns import finite, is_float, is_numeric, ratio
from tidegauge.functions.severity import detected, feature_severity, overall_severity, raises_alert, trips_gate
from tidegauge.operators.two_sample import BATCH, FEATURE, TwoSample, run_test

ALIGNMENT_SCHEMA = "level string, check string, feature string, message string"


def roles(reference: DataFrame, features: list[str]) -> dict[str, list[str]]:
    """Features by role; the type in the reference decides."""
    out: dict[str, list[str]] = {"num": [], "cat": []}
    for name in features:
        out["num" if is_numeric(reference.schema[name].dataType) else "cat"].append(name)
    return out


def alignment(reference: DataFrame, batches: DataFrame, features: list[str], ignore: tuple[str, ...] = ()) -> list[tuple]:
    """Schema findings as rows (level, check, feature, message). Reads schemas only."""
    if not features:
        return [("error", "no_features", None, "no features to compare")]
    ref, cur = set(reference.columns), set(batches.columns)
    found = [("error", "missing_in_reference", c, f"feature {c} is missing in the reference") for c in sorted(set(features) - ref)]
    found += [("error", "missing_in_batch", c, f"feature {c} is missing in the batch") for c in sorted(set(features) - cur)]
    errors = bool(found)
    found += [
        ("warning", "extra_column", c, f"column {c} is ignored") for c in sorted(cur - set(features) - set(ignore))
    ]
    if errors:
        return found
    for c in features:
        in_ref, in_cur = is_numeric(reference.schema[c].dataType), is_numeric(batches.schema[c].dataType)
        if in_ref != in_cur:
            kinds = ("numeric", "categorical") if in_ref else ("categorical", "numeric")
            found.append(("error", "type_mismatch", c, f"feature {c} is {kinds[0]} in the reference, {kinds[1]} in the batch"))
    return found


def alignment_table(reference: DataFrame, batches: DataFrame, features: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """The findings as a table, with one more warning where the batch side has no rows."""
    spark: SparkSession = reference.sparkSession
    schema_rows = spark.createDataFrame(alignment(reference, batches, features, ignore), ALIGNMENT_SCHEMA)
    empty = (
        batches.limit(1)
        .agg(F.count("*").alias("n"))
        .where("n = 0")
        .select(
            F.lit("warning").alias("level"),
            F.lit("empty_batch").alias("check"),
            F.lit(None).cast("string").alias("feature"),
            F.lit("the batch has no rows").alias("message"),
        )
    )
    return schema_rows.unionByName(empty)


def require_alignment(reference: DataFrame, batches: DataFrame, features: list[str], ignore: tuple[str, ...] = ()) -> None:
    errors = [m for level, _, _, m in alignment(reference, batches, features, ignore) if level == "error"]
    if errors:
        raise ValueError("feature alignment failed: " + "; ".join(errors))


def batch_sizes(batches: DataFrame, batch: str) -> DataFrame:
    return (
        batches.where(F.col(batch).isNotNull())
        .groupBy(F.col(batch).cast("string").alias(BATCH))
        .agg(F.count("*").alias("row_count"))
    )


def large_enough(batches: DataFrame, batch: str, minimum: int) -> DataFrame:
    """Rows of the batches that have at least ``minimum`` rows; smaller batches give no result."""
    big = batch_sizes(batches, batch).where(F.col("row_count") >= minimum).select(BATCH)
    return batches.join(big, batches[batch].cast("string") == big[BATCH], "left_semi")


def small_sample(n_ref: Column, n_cur: Column, limit: int = DriftConfig.small_sample) -> Column:
    """The warning list of a batch."""
    few = (n_ref < limit) | (n_cur < limit)
    return F.when(few, F.array(F.lit("small_sample"))).otherwise(F.array().cast("array<string>"))


def feature_grid(
    reference: DataFrame, batches: DataFrame, features: list[str], batch: str, config: DriftConfig, minimum: int = 0
) -> DataFrame:
    """(batch, row_count, feature, column_type, stattest_name, stattest_threshold, is_lost, is_infinite): every batch of
    at least ``minimum`` rows with every feature.

    A feature is lost where one side has values and the other has none, and infinite where either side has an infinite
    number, which counts as missing. Each task sends one row per batch; the batches are read once for all of it.
    """
    plan = {"num": (config.numeric_test, config.numeric_threshold), "cat": (config.categorical_test, config.categorical_threshold)}
    role = {name: r for r, names in roles(reference, features).items() for name in names}

    def present(df: DataFrame) -> list[Column]:
        found = []
        for i, c in enumerate(features):
            known, infinite = F.col(c).isNotNull(), F.lit(False)
            if is_float(df.schema[c].dataType):
                infinite = F.abs(F.col(c)) == F.lit(float("inf"))
                known = finite(F.col(c)).isNotNull()
            found += [F.coalesce(F.max(known), F.lit(False)).alias(f"has_{i}"), F.coalesce(F.max(infinite), F.lit(False)).alias(f"inf_{i}")]
        return found

    flags = [f"{n}_{i}" for n in ("has", "inf") for i in range(len(features))]
    known = reference.agg(*present(reference)).select(F.struct(*flags)).scalar()
    name = F.col(batch).cast("string").alias(BATCH)
    sides = batches.where(F.col(batch).isNotNull()).groupBy(name).agg(F.count("*").alias("row_count"), *present(batches))
    if minimum:
        sides = sides.where(F.col("row_count") >= minimum)
    rows = [
        F.struct(
            F.lit(c).alias(FEATURE),
            F.lit(role[c]).alias("column_type"),
            F.lit(plan[role[c]][0]).alias("stattest_name"),
            F.lit(plan[role[c]][1]).alias("stattest_threshold"),
            (F.col(f"has_{i}") != F.col("known")[f"has_{i}"]).alias("is_lost"),
            (F.col(f"inf_{i}") | F.col("known")[f"inf_{i}"]).alias("is_infinite"),
        )
        for i, c in enumerate(features)
    ]
    return sides.withColumn("known", known).select(BATCH, "row_count", F.inline(F.array(*rows)))


TABLE = (BATCH, FEATURE, "column_type", "stattest_name", "stattest_threshold", "drift_score", "drift_detected", "severity")


def scored_grid(
    reference: DataFrame, batches: DataFrame, features: list[str], batch: str, config: DriftConfig = DriftConfig(), minimum: int = 0
) -> DataFrame:
    """The rows of ``feature_table`` with row_count and is_infinite, for batches of at least ``minimum`` rows.

    Every batch is scored and the small ones are left out here, so rows need not be filtered before they are counted.
    """
    parts = []
    by_role = roles(reference, features)
    for role, test in (("num", config.numeric_test), ("cat", config.categorical_test)):
        if not by_role[role]:
            continue
        sample = TwoSample(reference, batches, by_role[role], batch, role == "num")
        parts.append(run_test(test, sample, config).select(BATCH, FEATURE, F.col("score").alias("drift_score")))
    scored = parts[0]
    for other in parts[1:]:
        scored = scored.unionByName(other)
    grid = feature_grid(reference, batches, features, batch, config, minimum)
    return grade_rows(grid, scored, [BATCH, FEATURE], config).select(*TABLE, "row_count", "is_infinite")


def grade_rows(grid: DataFrame, scored: DataFrame, keys: list[str], config: DriftConfig) -> DataFrame:
    """The rows of ``grid`` with drift_score, drift_detected and severity; ``scored`` has the scores by ``keys``."""
    score = F.when(~F.col("is_lost"), F.col("drift_score"))
    table = grid.join(scored, keys, "left").withColumn("drift_score", score)
    hit = F.coalesce(detected(F.col("drift_score"), F.col("stattest_name"), F.col("stattest_threshold")), F.lit(False))
    grade = feature_severity(F.col("drift_score"), F.col("drift_detected"), F.col("stattest_name"), config)
    return table.withColumn("drift_detected", F.col("is_lost") | hit).withColumn(
        "severity", F.when(F.col("is_lost"), "high").otherwise(grade)
    ).drop("is_lost")


def feature_table(
    reference: DataFrame, batches: DataFrame, features: list[str], batch: str, config: DriftConfig = DriftConfig()
) -> DataFrame:
    """(batch, feature, column_type, stattest_name, stattest_threshold, drift_score, drift_detected, severity).

    One row for every batch and feature. Where one side has no value of a feature at all, the score is null and the
    feature has drifted with severity high; where neither side has one, the score is null and it has not.
    """
    return scored_grid(reference, batches, features, batch, config).select(*TABLE)


def _verdict(df: DataFrame, config: DriftConfig) -> DataFrame:
    """Add share, verdict and severity to the feature counts of a batch."""
    share = ratio(F.col("drifted_feature_count"), F.col("total_feature_count"))
    return df.withColumn("drift_share", share).withColumns(
        {
            "dataset_drift_detected": F.col("drift_share") >= config.drift_share,
            "overall_severity": overall_severity(F.col("drift_share"), config),
        }
    )


def dataset_table(features: DataFrame, config: DriftConfig = DriftConfig(), *extra: Column) -> DataFrame:
    """One row per batch: drifted and total features, their share, whether the batch drifted, its severity."""
    drifted = F.sum(F.col("drift_detected").cast("int")).cast("bigint")
    out = features.groupBy(BATCH).agg(
        drifted.alias("drifted_feature_count"), F.count("*").alias("total_feature_count"), *extra
    )
    return _verdict(out, config).withColumnRenamed("overall_severity", "severity")


def with_verdict(features: DataFrame, config: DriftConfig = DriftConfig(), keys: tuple[str, ...] = (BATCH,)) -> DataFrame:
    """The feature rows with their batch's verdict beside them, from one window over a batch's few rows."""
    whole = Window.partitionBy(*keys)
    counted = features.withColumns(
        {
            "drifted_feature_count": F.sum(F.col("drift_detected").cast("int")).over(whole),
            "total_feature_count": F.count("*").over(whole),
        }
    )
    return _verdict(counted, config).drop("drifted_feature_count", "total_feature_count")


def with_alerts(overall: DataFrame, config: DriftConfig = DriftConfig(), interactive: bool = False) -> DataFrame:
    return overall.withColumns(
        {
            "alert": raises_alert(F.col("severity"), config.alert_severity),
            "gate": trips_gate(F.col("severity"), config.fail_on_severity, interactive),
        }
    )


def method_label(config: DriftConfig) -> str:
    num, cat = config.numeric_test, config.categorical_test
    return num if num == cat else f"{num}/{cat}"


def result_records(
    features: DataFrame,
    reference: DataFrame,
    config: DriftConfig = DriftConfig(),
    task_type: str = "classification",
    run_id: str = "monitoring",
    version_id: str = "batch",
    generated_at: Column | None = None,
) -> DataFrame:
    """One nested record per batch. ``features`` are the rows of ``scored_grid``.

    The features map of a record has one entry per feature column, so its size is that of the schema.
    """
    entry = F.struct(
        F.col(FEATURE),
        F.struct("column_type", "drift_detected", "drift_score", "stattest_name", "stattest_threshold", "severity"),
    )
    graded = [
        F.sum((F.col("severity") == s).cast("int")).cast("bigint").alias(f"n_{s}") for s in ("low", "medium", "high")
    ]
    by_feature = F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("features")
    is_lost = F.col("drift_score").isNull() & F.col("drift_detected")
    lost = F.array_sort(F.collect_list(F.when(is_lost, F.concat(F.lit("missing_feature:"), F.col(FEATURE))))).alias("lost")
    infinite = F.array_sort(F.collect_list(F.when(F.col("is_infinite"), F.concat(F.lit("non_finite:"), F.col(FEATURE))))).alias("infinite")
    joined = dataset_table(features, config, F.max("row_count").alias("row_count"), by_feature, lost, infinite, *graded).withColumn(
        "ref_rows", reference.agg(F.count("*")).scalar()
    )
    snapshot = {
        "stattest_numerical": config.numeric_test,
        "stattest_categorical": config.categorical_test,
        "stattest_threshold_numerical": config.numeric_threshold,
        "stattest_threshold_categorical": config.categorical_threshold,
        "drift_share_threshold": config.drift_share,
        "severity_low_max": config.low_max,
        "severity_medium_max": config.medium_max,
    }
    total = F.col("total_feature_count")
    return joined.select(
        BATCH,
        F.lit(RECORD_VERSION).alias("schema_version"),
        F.lit("tabular").alias("drift_type"),
        F.lit(method_label(config)).alias("method"),
        (generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"),
        F.lit(run_id).alias("pipeline_execution_id"),
        F.lit(version_id).alias("dataset_version_id"),
        F.lit(task_type).alias("task_type"),
        F.struct(
            F.lit(config.reference_source).alias("source"), F.col("ref_rows").alias("row_count"), total.alias("feature_count")
        ).alias("reference_dataset"),
        F.struct(F.lit("batch").alias("source"), F.col("row_count"), total.alias("feature_count")).alias("current_dataset"),
        F.struct(
            "dataset_drift_detected",
            F.col("drift_share").alias("drift_score"),
            "drift_share",
            "drifted_feature_count",
            "total_feature_count",
            "severity",
        ).alias("overall"),
        "features",
        F.struct(*[F.col(f"n_{s}").alias(s) for s in ("low", "medium", "high")]).alias("severity_counts"),
        F.concat(small_sample(F.col("ref_rows"), F.col("row_count"), config.small_sample), F.col("lost"), F.col("infinite")).alias("warnings"),
        F.create_map().cast("map<string,string>").alias("artifacts"),
        F.create_map(*[F.lit(str(x)) for kv in snapshot.items() for x in kv]).alias("config_snapshot"),
    )
