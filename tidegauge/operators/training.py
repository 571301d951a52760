"""Training and batch scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.boosting import PenalisedBoosting
from tidegauge.operators.split import with_class_weight

MAX_DEPTH = 30  # Spark's own limit, used where the depth is left open
SCORE_DIGITS = 4
# fixed values: the defaults of the training configuration
FOREST = {"n_estimators": 100, "max_depth": None, "min_samples_split": 2, "class_weight": "balanced"}
LOGISTIC = {"C": 1.0, "max_iter": 1000, "class_weight": None}
BOOSTING = {"max_iter": 300, "learning_rate": 0.05, "max_depth": 7, "min_samples_leaf": 20, "l2_regularization": 0.1}
# Settings that Spark's models lack: kept in the record under a name that says so.
UNUSED = {"random_forest": ("min_samples_split",)}
ALGORITHMS = {
    "classification": ("random_forest", "logistic_regression"),
    "regression": ("random_forest", "gradient_boosting", "linear_regression"),
}


def _depth(wanted: int | None) -> int:
    if wanted is not None and wanted > MAX_DEPTH:
        raise ValueError(f"max_depth {wanted} is above {MAX_DEPTH}, the deepest tree Spark grows")
    return MAX_DEPTH if wanted is None else wanted


def _forest_args(hp: dict, seed: int) -> dict:
    return {
        "numTrees": hp["n_estimators"],
        "maxDepth": _depth(hp["max_depth"]),
        "minInstancesPerNode": 1,  # Spark has no least size of a node to split
        "seed": seed,
    }


def random_forest_classifier(hp: dict, seed: int, rows: int):
    return RandomForestClassifier(**_forest_args({**FOREST, **hp}, seed))


def random_forest_regressor(hp: dict, seed: int, rows: int):
    return RandomForestRegressor(featureSubsetStrategy="all", **_forest_args({**FOREST, **hp}, seed))


def logistic_regression(hp: dict, seed: int, rows: int):
    """Spark divides the loss by the number of rows, so the penalty 1/C is divided too."""
    hp = {**LOGISTIC, **hp}
    return LogisticRegression(regParam=1.0 / (hp["C"] * max(rows, 1)), maxIter=hp["max_iter"], standardization=False)


def linear_regression(hp: dict, seed: int, rows: int):
    return LinearRegression(regParam=0.0)


def gradient_boosting_regressor(hp: dict, seed: int, rows: int):
    hp = {**BOOSTING, **hp}
    return PenalisedBoosting(
        trees=hp["max_iter"],
        rate=hp["learning_rate"],
        depth=_depth(hp["max_depth"]),
        min_rows=hp["min_samples_leaf"],
        penalty=hp["l2_regularization"],
        seed=seed,
    )


BUILDERS: dict[tuple[str, str], Callable] = {
    ("classification", "random_forest"): random_forest_classifier,
    ("classification", "logistic_regression"): logistic_regression,
    ("regression", "random_forest"): random_forest_regressor,
    ("regression", "gradient_boosting"): gradient_boosting_regressor,
    ("regression", "linear_regression"): linear_regression,
}


@dataclass
class TrainingResult:
    model: PipelineModel
    algorithm: str
    task_type: str
    hyperparameters: dict
    dataset_version_id: str
    seed: int
    train_rows: int
    features: list[str] = field(default_factory=list)
    target: str = ""
    trained_at: str = ""

    def run_record(self) -> dict[str, str]:
        """What a run stores about its model; an open hyperparameter is written ``null``, one that the model lacks as
        ``unused_hp``."""
        idle = UNUSED.get(self.algorithm, ())
        named = {
            f"{'unused_hp' if k in idle else 'hp'}.{k}": "null" if v is None else str(v) for k, v in sorted(self.hyperparameters.items())
        }
        return {
            "algorithm": self.algorithm,
            "task_type": self.task_type,
            "dataset_version_id": self.dataset_version_id,
            "random_seed": str(self.seed),
            "train_rows": str(self.train_rows),
            "trained_at": self.trained_at,
            **named,
        }


def check_columns(train: DataFrame, feature_map: dict) -> None:
    """The training table must have exactly the contract's columns, in its order."""
    expected = [*feature_map["output_features"], feature_map["target"]]
    if train.columns != expected:
        raise ValueError(f"training columns {train.columns} differ from the feature map {expected}")


def train_tabular(
    train: DataFrame,
    feature_map: dict,
    algorithm: str,
    task_type: str,
    hyperparameters: dict | None = None,
    version: str = "",
    seed: int = 42,
) -> TrainingResult:
    """Fit a model on a prepared table; labels of classification are text in, text out."""
    check_columns(train, feature_map)
    if (task_type, algorithm) not in BUILDERS:
        raise ValueError(f"no {algorithm} for {task_type}; known: {ALGORITHMS.get(task_type, ())}")
    features, target = feature_map["output_features"], feature_map["target"]
    hp = hyperparameters or {}
    rows = train.count()
    estimator = BUILDERS[task_type, algorithm](hp, seed, rows)
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="error")
    estimator.setFeaturesCol("_features")
    defaults = {"random_forest": FOREST, "logistic_regression": LOGISTIC, "gradient_boosting": BOOSTING}.get(algorithm, {})
    used = {**defaults, **hp}
    data = train
    if task_type == "classification":
        data = data.withColumn(target, F.col(target).cast("string"))
        if used.get("class_weight") == "balanced":
            data = with_class_weight(data, target, "_weight")
            estimator.setWeightCol("_weight")
        indexer = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(data)
        estimator.setLabelCol("_label").setPredictionCol("_prediction")
        back = IndexToString(inputCol="_prediction", outputCol="prediction", labels=indexer.labels)
        fitted = Pipeline(stages=[assembler, estimator]).fit(indexer.transform(data))
        model = PipelineModel([*fitted.stages, back])
    else:
        estimator.setLabelCol(target).setPredictionCol("prediction")
        model = Pipeline(stages=[assembler, estimator]).fit(data)
    at = datetime.now(UTC).isoformat(timespec="seconds")
    return TrainingResult(model, algorithm, task_type, used, version, seed, rows, features, target, at)


def run_records(df_source: DataFrame, results: list[TrainingResult], run_ids: list[str]) -> DataFrame:
    """(run_id, params) rows of trained models; one row per model object the caller holds."""
    rows = [(r, t.run_record()) for r, t in zip(run_ids, results)]
    return df_source.sparkSession.createDataFrame(rows, "run_id string, params map<string,string>")


def score_batch(
    rows: DataFrame, model: PipelineModel, features: list[str], task_type: str, keep: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected): predictions as text beside ``keep``; rows whose features do not read as numbers are
    rejected with the names of those features. Regression is rounded to four digits."""
    missing = [c for c in features if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required features: {missing}")
    raw = {c: f"_raw_{i}" for i, c in enumerate(features)}
    cast = rows.select(
        *keep,
        *[F.col(c).cast("string").try_cast("double").alias(raw[c]) for c in features],
    )
    bad = F.array_compact(F.array(*[F.when(F.col(raw[c]).isNull(), F.lit(c)) for c in features]))
    marked = cast.withColumn("invalid_features", bad)
    good = marked.where(F.size("invalid_features") == 0)
    kept = good.select(*[F.col(k).alias(f"_keep_{k}") for k in keep], *[F.col(raw[c]).alias(c) for c in features])
    scored = model.transform(kept)
    value = F.col("prediction")
    if task_type == "regression":
        columns = [value.alias("_p"), F.format_string(f"%.{SCORE_DIGITS}f", F.bround(value, SCORE_DIGITS)).alias("prediction")]
    else:
        columns = [value.cast("string").alias("prediction")]
    out = scored.select(*[F.col(f"_keep_{k}").alias(k) for k in keep], *columns)
    if task_type == "regression":
        out = out.withColumn("value", F.bround("_p", SCORE_DIGITS)).drop("_p")
    return out, marked.where(F.size("invalid_features") > 0).select(*keep, "invalid_features")


def display_note(value: Column, multiplier: float, unit: str, label: str) -> Column:
    """A readable note: the value in the unit people use, and the raw output it came from."""
    human = F.format_number(value * F.lit(float(multiplier)), 0)
    raw = F.format_string(f"%.{SCORE_DIGITS}f", value)
    scale = f"{unit}{multiplier:,.0f}"
    return F.concat(F.lit(f"≈ {unit}"), human, F.lit(f" · {label} (raw model output: "), raw, F.lit(f" × {scale})"))
