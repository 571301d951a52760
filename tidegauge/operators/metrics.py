"""Evaluation: metrics of many models, splits or scenarios from one confusion count each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import half_even, no_nan, ratio, zero_safe
from tidegauge.operators.split import null_safe_join

CLASSIFICATION = ("accuracy", "precision", "recall", "f1_score")
REGRESSION = ("mae", "mse", "rmse", "r2")
AVERAGING = ("weighted", "macro", "binary")
DIGITS = 4
# fixed values: drop in accuracy from which a scenario counts as high or medium
SENSITIVITY_HIGH, SENSITIVITY_MEDIUM = 0.15, 0.05
MIN_ANALYSIS_ACCURACY = 0.6
CLASS_BLOCK = 1024  # classes of a confusion matrix that are held at once


def confusion_counts(df: DataFrame, label: str, prediction: str, by: list[str]) -> DataFrame:
    """(by…, label, prediction, n) of the rows where both are present."""
    pair = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    return pair.groupBy(
        *by, F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")
    ).agg(F.count("*").alias("n"))


def class_table(df: DataFrame, label: str, prediction: str, by: list[str]) -> DataFrame:
    """(by…, class, support, predicted, hits) for every class that occurs on either side."""
    counts = confusion_counts(df, label, prediction, by)
    n, none = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(none)
    two_rows = [F.col("label"), n, none, hit, F.col("prediction"), none, n, none]
    sides = counts.select(*by, F.stack(F.lit(2), *two_rows).alias("class", "s", "p", "h"))
    return sides.groupBy(*by, "class").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))


def classification_metrics(
    df: DataFrame, label: str, prediction: str, by: list[str], averaging: str = "weighted", positive: str = "1"
) -> DataFrame:
    """(by…, accuracy, precision, recall, f1_score, n_samples), rounded to 4; 0/0 counts as 0."""
    if averaging not in AVERAGING:
        raise ValueError(f"averaging must be one of {AVERAGING}, got {averaging!r}")
    rows = class_table(df, label, prediction, by).withColumns(
        {
            "pre": zero_safe(F.col("hits"), F.col("predicted")),
            "rec": zero_safe(F.col("hits"), F.col("support")),
            "f1": zero_safe(2.0 * F.col("hits"), F.col("support") + F.col("predicted")),
        }
    )

    def averaged(c: str) -> Column:
        if averaging == "weighted":
            return zero_safe(F.sum(F.col(c) * F.col("support")), F.sum("support"))
        if averaging == "macro":
            return F.avg(c)
        return F.coalesce(F.max(F.when(F.col("class") == positive, F.col(c))), F.lit(0.0))

    out = rows.groupBy(*by).agg(
        half_even(zero_safe(F.sum("hits"), F.sum("support")), DIGITS).alias("accuracy"),
        half_even(averaged("pre"), DIGITS).alias("precision"),
        half_even(averaged("rec"), DIGITS).alias("recall"),
        half_even(averaged("f1"), DIGITS).alias("f1_score"),
        F.sum("support").alias("n_samples"),
    )
    return out


def confusion_matrix(df: DataFrame, label: str, prediction: str, by: list[str]) -> DataFrame:
    """(by…, label, prediction, n) with a row for every pair of classes of a group, zeros included.

    The classes of a group are dealt into blocks of about CLASS_BLOCK by hash. Each class, as a label, meets each
    block of predictions once: the pairs that were counted come from the counts, the rest of the block are zeros.
    So a task holds one block, and what is shuffled is the counts and one row per (class, block), never the grid.
    Groups may be null, as in a grouping.
    """
    counts = confusion_counts(df, label, prediction, by)
    classes = counts.select(*by, F.explode(F.array("label", "prediction")).alias("c")).distinct()
    most = classes.groupBy(*by).agg(F.count("*").alias("k")).agg(F.max("k")).scalar()
    number = F.coalesce(F.ceil(most / F.lit(float(CLASS_BLOCK))), F.lit(1)).cast("int")

    def block(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.col("_number")).cast("int").alias("_block")

    blocks = classes.withColumn("_number", number).select(*by, block("c"), "c").groupBy(*by, "_block").agg(F.collect_list("c").alias("_all"))
    seen = counts.withColumn("_number", number).select(*by, "label", block("prediction"), "prediction")
    seen = seen.groupBy(*by, "label", "_block").agg(F.collect_list("prediction").alias("_seen"))
    spread = classes.withColumn("_number", number).select(
        *by, F.col("c").alias("label"), F.explode(F.sequence(F.lit(0), F.col("_number") - 1)).alias("_block")
    )
    # few bytes become many rows here: an explicit number of tasks, which adaptive execution does not merge
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    spread = spread.repartition(tasks, *by, "label", "_block")
    known = null_safe_join(spread, seen, [*by, "label", "_block"], "left")
    rest = F.array_except("_all", F.coalesce("_seen", F.array().cast("array<string>")))
    zeros = null_safe_join(known, blocks, [*by, "_block"]).select(*by, "label", F.explode(rest).alias("prediction"))
    return counts.unionByName(zeros.withColumn("n", F.lit(0).cast("bigint")))


def regression_metrics(df: DataFrame, label: str, prediction: str, by: list[str]) -> DataFrame:
    """(by…, mae, mse, rmse, r2, n_samples), rounded to 4; r2 is 1 - Σe²/Σ(y-ȳ)²."""
    y, p = no_nan(df, label).cast("double"), no_nan(df, prediction).cast("double")
    rows = df.where(y.isNotNull() & p.isNotNull()).select(*by, y.alias("_y"), (y - p).alias("_e"))
    out = rows.groupBy(*by).agg(
        F.avg(F.abs("_e")).alias("mae"),
        F.avg(F.col("_e") * F.col("_e")).alias("mse"),
        F.var_pop("_y").alias("_var"),
        F.count("*").alias("n_samples"),
    )
    flat = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.coalesce(1.0 - ratio(F.col("mse"), F.col("_var")), flat)
    return out.select(
        *by,
        half_even(F.col("mae"), DIGITS).alias("mae"),
        half_even(F.col("mse"), DIGITS).alias("mse"),
        half_even(F.sqrt("mse"), DIGITS).alias("rmse"),
        half_even(r2, DIGITS).alias("r2"),
        "n_samples",
    )


def long_metrics(wide: DataFrame, by: list[str], names: tuple[str, ...]) -> DataFrame:
    """(by…, metric, value) of a wide metric table."""
    pairs = [x for m in names for x in (F.lit(m), F.col(m).cast("double"))]
    return wide.select(*by, F.stack(F.lit(len(names)), *pairs).alias("metric", "value"))


def evaluate_splits(
    df: DataFrame, label: str, prediction: str, split: str, by: list[str], task_type: str = "classification", averaging: str = "weighted"
) -> DataFrame:
    """(by…, metric, val, test): validation metrics beside those of the test split, null where it is empty."""
    scored = df.where(F.col(split).isin("val", "test"))
    keys = [*by, split]
    if task_type == "regression":
        long = long_metrics(regression_metrics(scored, label, prediction, keys), keys, REGRESSION)
    else:
        long = long_metrics(classification_metrics(scored, label, prediction, keys, averaging), keys, CLASSIFICATION)
    sides = [F.max(F.when(F.col(split) == s, F.col("value"))).alias(s) for s in ("val", "test")]
    return long.groupBy(*by, "metric").agg(*sides).where("val is not null")


def holdout_metrics(
    holdout: DataFrame, known: DataFrame, label: str, prediction: str, by: list[str], task_type: str = "classification"
) -> DataFrame:
    """Metrics of held-out rows whose class the model knows; other classes are left out. Adds the class counts."""
    if task_type == "regression":
        return regression_metrics(holdout, label, prediction, by)
    kept = holdout.join(known.select(F.col(known.columns[0]).alias("_k")).distinct(), F.col(label).cast("string") == F.col("_k"), "left_semi")
    shown = kept.groupBy(*by, F.col(label).cast("string").alias("c")).agg(F.count("*").alias("k"))
    spread = shown.groupBy(*by).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "k"))))).alias("class_distribution")
    )
    scores = classification_metrics(kept, label, prediction, by)
    return scores.join(spread, by) if by else scores.withColumn("class_distribution", spread.scalar())


def before_after(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """(by…, metric, baseline, after, delta) of the shared metrics; counts of samples are no metric."""
    b = before.select(*by, "metric", F.col("value").alias("baseline"))
    a = after.select(*by, "metric", F.col("value").alias("after"))
    joined = b.join(a, [*by, "metric"]).where("metric <> 'n_samples'")
    return joined.withColumn("delta", half_even(F.col("after") - F.col("baseline"), DIGITS))


def improved(deltas: DataFrame, by: list[str]) -> DataFrame:
    """(by…, improved): whether the leading metric (accuracy, or r2) rose."""
    lead = F.max(F.when(F.col("metric").isin("accuracy", "r2"), F.col("delta")))
    return deltas.groupBy(*by).agg((F.coalesce(lead, F.lit(0.0)) > 0).alias("improved"))


def sensitivity(scenarios: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """Scenario metrics against the baseline's, with the change of each, a grade and the rank by its size.

    ``scenarios`` is (by…, scenario, metrics…), ``baseline`` (by…, metrics…). Rank 1 is the most sensitive.
    """
    base = baseline.select(*by, *[F.col(m).alias(f"base_{m}") for m in CLASSIFICATION])
    if by:
        joined = scenarios.join(base, by, "left")
    else:
        one = base.agg(F.first(F.struct(*base.columns))).scalar()
        joined = scenarios.withColumns({c: one[c] for c in base.columns})
    out = joined.withColumns({f"delta_{m}": half_even(F.col(m) - F.col(f"base_{m}"), DIGITS) for m in CLASSIFICATION})
    drop = F.abs(F.coalesce("delta_accuracy", F.lit(0.0)))
    grade = F.when(drop >= SENSITIVITY_HIGH, "high").when(drop >= SENSITIVITY_MEDIUM, "medium").otherwise("low")
    order = Window.partitionBy(*by).orderBy(F.desc("_drop"), F.asc("scenario"))
    out = out.withColumn("_drop", drop).withColumns({"sensitivity": grade, "place": F.row_number().over(order)})
    return out.drop("_drop", *[f"base_{m}" for m in CLASSIFICATION])


def extremes(ranked: DataFrame, by: list[str]) -> DataFrame:
    """(by…, most_sensitive, least_sensitive, scenario_count) of the ranked scenarios."""
    return ranked.groupBy(*by).agg(
        F.min_by("scenario", "place").alias("most_sensitive"),
        F.max_by("scenario", "place").alias("least_sensitive"),
        F.count("*").alias("scenario_count"),
    )


def analysis_gate(metrics: DataFrame, by: list[str], minimum: float = MIN_ANALYSIS_ACCURACY) -> DataFrame:
    """(by…, accuracy, analyse): analysis is skipped for a model at or below the minimum; no accuracy counts as 1."""
    found = F.max(F.when(F.col("metric") == "accuracy", F.col("value")))
    out = metrics.groupBy(*by).agg(F.coalesce(found, F.lit(1.0)).alias("accuracy"))
    return out.withColumn("analyse", F.col("accuracy") > minimum)
