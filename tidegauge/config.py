"""Settings of the operators. The numbers are fixed values: they are the defaults users rely on."""

from __future__ import annotations

from dataclasses import dataclass, field

SEVERITIES = ("low", "medium", "high")
P_VALUE_TESTS = ("ks", "chisquare")
DISTANCE_TESTS = ("psi", "wasserstein", "jensenshannon")
RECORD_VERSION = "1.1.0"
IMAGE_RECORD_VERSION = "1.0.0"


@dataclass(frozen=True)
class DriftConfig:
    numeric_test: str = "ks"
    categorical_test: str = "chisquare"
    numeric_threshold: float = 0.05
    categorical_threshold: float = 0.05
    drift_share: float = 0.5
    # severity of a p-value test
    high_below: float = 0.001
    medium_below: float = 0.01
    # severity of a distance test, where a larger score is worse
    distance_medium: float = 0.10
    distance_high: float = 0.25
    # severity of the whole batch from its share of drifted features
    low_max: float = 0.25
    medium_max: float = 0.50
    min_batch_size: int = 10
    small_sample: int = 30
    alert_severity: str = "medium"
    fail_on_severity: str = "high"
    bins: int = 10
    share_floor: float = 1e-4
    unseen_expected: float = 0.5
    reference_source: str = "train"


@dataclass(frozen=True)
class ImageDriftConfig:
    medium: float = 0.10
    high: float = 0.25
    min_batch_size: int = 10
    match_limit: float = 0.20
    match_high: float = 0.05
    match_medium: float = 0.10
    pyramid_sigma: float = 0.5
    pyramid_levels: int = 3
    pyramid_min_side: int = 4


@dataclass(frozen=True)
class DataContract:
    name: str
    target: str
    types: dict[str, str]
    task_type: str = "classification"
    min_rows: int = 10
    max_null_fraction: float = 0.0
    label_classes: tuple[str, ...] = ()
    expected_formats: tuple[str, ...] = (".png",)
    min_images_per_class: int = 5
    splits: tuple[str, ...] = ("train", "val", "test")  # the splits a split table must have

    @property
    def features(self) -> list[str]:
        return [c for c in self.types if c != self.target]


@dataclass(frozen=True)
class FeatureConfig:
    null_policy: str = "passthrough"  # passthrough | fail | impute
    numeric_strategy: str = "mean"  # mean | median | constant
    categorical_strategy: str = "most_frequent"  # most_frequent | constant
    numeric_fill: float | None = None
    categorical_fill: str | None = None
    scaling: str | None = None  # standard | minmax
    encoding: str | None = None  # onehot | ordinal
    handle_unknown: str = "ignore"  # ignore | error
    min_frequency: int | None = None
    max_categories: int = 2000


@dataclass(frozen=True)
class PromotionRule:
    rule_id: str
    metric: str
    threshold: float
    operator: str = ">="
    description: str = ""


CLASSIFICATION_RULES = (
    PromotionRule("min_accuracy", "accuracy", 0.80, ">=", "Model accuracy must be at least 80%"),
    PromotionRule("min_f1", "f1_score", 0.75, ">=", "Weighted F1-score must be at least 75%"),
)
REGRESSION_RULES = (
    PromotionRule("min_r2", "r2", 0.80, ">=", "R² must be at least 0.80"),
    PromotionRule("max_mae", "mae", 0.40, "<=", "MAE must not exceed 0.40"),
)


@dataclass(frozen=True)
class MonitorRequest:
    """What a monitor run compares: the features and the column that names a batch."""

    features: tuple[str, ...]
    batch: str
    model: str = "model"
    task_type: str = "classification"
    warnings: tuple[str, ...] = field(default=())
