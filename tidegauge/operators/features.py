"""Feature preparation fitted on training rows and applied to any split as a plain projection.

A fit brings only column statistics and category lists to the driver: a few numbers per column and at most
``max_categories`` values per categorical column. Applying a fit is a select with literals.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import FeatureConfig
from tidegauge.functions.columns import finite, is_numeric, nan_to_null, no_nan, unpivot
from tidegauge.operators.contract import null_fail_fast
from tidegauge.operators.ordered import bucket_edges, in_text_buckets, running_sums, text_edges, thinned, with_bucket
from tidegauge.session import bucket_count

TOP_VALUES = 10
MAX_TEXT_BUCKETS = 512


def select_features(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return df.select(*features, target)


def feature_roles(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical features in their given order; a boolean is a category here."""
    numeric = [c for c in features if is_numeric(df.schema[c].dataType) and df.schema[c].dataType.typeName() != "boolean"]
    return numeric, [c for c in features if c not in numeric]


# --- exact quantiles ------------------------------------------------------------------------------------


def quantiles(df: DataFrame, columns: list[str], probs: list[float], buckets: int | None = None) -> DataFrame:
    """(feature, prob, value): exact quantiles with linear interpolation, from running value counts.

    No task holds a whole column, unlike the ``percentile`` aggregate, whose buffer keeps every distinct value.
    """
    counts = unpivot(df, [], columns, "double").groupBy("feature", "value").agg(F.count("*").alias("c"))
    k = bucket_count(df.select(*columns)) if buckets is None else buckets
    thin = unpivot(thinned(df.select(*columns)), [], columns, "double") if k > 1 else counts
    edges = bucket_edges(thin, ["feature"], "value", k)
    placed = with_bucket(counts, edges, ["feature"], "value")
    ranked = running_sums(placed, ["feature"], [F.col("value").asc()], {"upto": F.col("c")}, edges is not None)
    totals = counts.groupBy("feature").agg(F.sum("c").alias("n"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    spots = totals.select("feature", wanted, "n").withColumn("pos", F.col("prob") * (F.col("n") - 1))
    spots = spots.withColumns({"lo": F.floor("pos"), "hi": F.ceil("pos")})
    rows = ranked.select("feature", "value", "upto", (F.col("upto") - F.col("c")).alias("from"))
    hit = rows.join(F.broadcast(spots), "feature").where(
        ((F.col("from") <= F.col("lo")) & (F.col("lo") < F.col("upto")))
        | ((F.col("from") <= F.col("hi")) & (F.col("hi") < F.col("upto")))
    )
    low, high = F.min("value"), F.max("value")
    share = F.first("pos") - F.first("lo")
    return hit.groupBy("feature", "prob").agg((low + (high - low) * share).alias("value"))


# --- single fitted steps --------------------------------------------------------------------------------


def numeric_fills(train: DataFrame, columns: list[str], strategy: str, constant: float | None = None) -> dict[str, float]:
    """The value each numeric column's gaps are filled with."""
    if not columns:
        return {}
    if strategy == "constant":
        return {c: 0.0 if constant is None else float(constant) for c in columns}
    if strategy == "median":
        return {r["feature"]: r["value"] for r in quantiles(train, columns, [0.5]).collect()}
    if strategy == "mean":
        row = train.agg(*[F.avg(no_nan(train, c)).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns if row[c] is not None}
    raise ValueError(f"unknown numeric strategy {strategy!r}")


def value_table(train: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n) of the non-missing values of categorical columns."""
    return unpivot(train, [], columns, "string").groupBy("feature", "value").agg(F.count("*").alias("n"))


def most_frequent(train: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n): the most frequent value, of equals the smallest."""
    return (
        value_table(train, columns)
        .groupBy("feature")
        .agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"), F.max("n").alias("n"))
    )


def categorical_fills(train: DataFrame, columns: list[str], strategy: str, constant: str | None = None) -> dict[str, str]:
    if not columns:
        return {}
    if strategy == "constant":
        return {c: "missing_value" if constant is None else constant for c in columns}
    if strategy == "most_frequent":
        return {r["feature"]: r["value"] for r in most_frequent(train, columns).collect()}
    raise ValueError(f"unknown categorical strategy {strategy!r}")


def scale_stats(train: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Mean, population standard deviation, minimum and maximum of each column, in one pass."""
    if not columns:
        return {}
    wanted = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    row = train.agg(*[f(no_nan(train, c).cast("double")).alias(f"{c}|{n}") for c in columns for n, f in wanted.items()]).first()
    return {c: {n: row[f"{c}|{n}"] for n in wanted} for c in columns}


def scaled(value: Column, stats: dict[str, float], strategy: str) -> Column:
    """z-score (a zero deviation counts as 1) or the place between the train minimum and maximum (not clipped)."""
    if strategy == "standard":
        return (value - F.lit(stats["mean"])) / F.lit(stats["std"] or 1.0)
    if strategy == "minmax":
        return (value - F.lit(stats["min"])) / F.lit((stats["max"] - stats["min"]) or 1.0)
    raise ValueError(f"unknown scaling {strategy!r}")


def categories(train: DataFrame, columns: list[str], limit: int, min_frequency: int | None = None) -> dict[str, dict[str, list[str]]]:
    """Per column the sorted categories, and those rarer than ``min_frequency`` under ``rare``."""
    if not columns:
        return {}
    counted = value_table(train, columns)
    wide = [r["feature"] for r in counted.groupBy("feature").agg(F.count("*").alias("k")).where(F.col("k") > limit).collect()]
    if wide:
        raise ValueError(f"columns {sorted(wide)} have more than {limit} categories; use ordinal_table, a join")
    out: dict[str, dict[str, list[str]]] = {c: {"kept": [], "rare": []} for c in columns}
    for r in counted.orderBy("feature", "value").collect():
        kind = "rare" if min_frequency is not None and r["n"] < min_frequency else "kept"
        out[r["feature"]][kind].append(r["value"])
    return out


RARE = "infrequent_sklearn"  # fixed value: the column suffix users of one-hot names know


def onehot_columns(column: str, value: Column, found: dict[str, list[str]]) -> list[Column]:
    """One 0/1 column per category, rare ones folded into one; an unknown value is 0 everywhere."""
    out = [F.coalesce((value == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{column}_{v}") for v in found["kept"]]
    if found["rare"]:
        out.append(F.coalesce(value.isin(*found["rare"]).cast("double"), F.lit(0.0)).alias(f"{column}_{RARE}"))
    return out


def ordinal_table(train: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """(value, code): sorted category to 0..k-1, for any number of categories.

    Codes come from running sums over ordered buckets, so no task sorts all categories.
    """
    distinct = train.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    number = min(bucket_count(train.select(column)), MAX_TEXT_BUCKETS) if buckets is None else buckets
    edges = text_edges(distinct, "value", number)
    placed = in_text_buckets(distinct, "value", edges)
    ranked = running_sums(placed, [], [F.col("value").asc()], {"upto": F.lit(1)}, bucketed=bool(edges))
    return ranked.select("value", (F.col("upto") - 1).cast("bigint").alias("code"))


def encode_ordinal(df: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    """Add the code of each value; an unknown or missing one is -1."""
    table = codes.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
    joined = df.join(table, df[column].cast("string") == F.col("_v"), "left")
    return joined.select(*df.columns, F.coalesce("_c", F.lit(-1)).cast("bigint").alias(name))


# --- the whole plan -------------------------------------------------------------------------------------


@dataclass
class FittedFeatures:
    """A fitted preparation: plain values, so it can be stored as JSON beside a model."""

    target: str
    numeric: list[str]
    categorical: list[str]
    config: dict
    numeric_fill: dict[str, float] = field(default_factory=dict)
    categorical_fill: dict[str, str] = field(default_factory=dict)
    scale: dict[str, dict[str, float]] = field(default_factory=dict)
    category: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    @property
    def output_features(self) -> list[str]:
        encoding = self.config["encoding"]
        if encoding != "onehot":
            return self.numeric + self.categorical
        out = list(self.numeric)
        for c in self.categorical:
            out += [f"{c}_{v}" for v in self.category[c]["kept"]]
            out += [f"{c}_{RARE}"] if self.category[c]["rare"] else []
        return out

    def feature_map(self) -> dict:
        return {
            "output_features": self.output_features,
            "target": self.target,
            "numeric_input": self.numeric,
            "categorical_input": self.categorical,
        }

    def to_dict(self) -> dict:
        return asdict(self)

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Numeric columns first, then categorical ones, then the target; ``keep`` adds columns in front."""
        config = FeatureConfig(**self.config)
        if config.encoding and config.handle_unknown == "error":
            self._refuse_unknown(df)
        columns: list[Column] = []
        for c in self.numeric:
            value = no_nan(df, c)
            if c in self.numeric_fill:
                value = F.coalesce(value, F.lit(self.numeric_fill[c]))
            if config.scaling:
                value = scaled(value.cast("double"), self.scale[c], config.scaling)
            columns.append(value.alias(c))
        for c in self.categorical:
            value = F.col(c).cast("string")
            if c in self.categorical_fill:
                value = F.coalesce(value, F.lit(self.categorical_fill[c]))
            if config.encoding == "onehot":
                columns += onehot_columns(c, value, self.category[c])
            elif config.encoding == "ordinal":
                columns.append(self._ordinal(c, value).alias(c))
            else:
                columns.append(value.alias(c))
        return df.select(*[F.col(k) for k in keep], *columns, F.col(self.target))

    def _ordinal(self, column: str, value: Column) -> Column:
        values = self.category[column]["kept"]
        if not values:
            return F.lit(-1.0)
        place = F.array_position(F.array(*[F.lit(v) for v in values]), value)
        return (F.coalesce(place, F.lit(0)) - 1).cast("double")

    def _refuse_unknown(self, df: DataFrame) -> None:
        checks = []
        for c in self.categorical:
            known = self.category[c]["kept"] + self.category[c]["rare"]
            value = F.coalesce(F.col(c).cast("string"), F.lit(self.categorical_fill.get(c)))
            checks.append(F.count_if(~F.coalesce(value.isin(*known), F.lit(False))).alias(c))
        row = df.agg(*checks).first() if checks else {}
        bad = {c: row[c] for c in self.categorical if checks and row[c]}
        if bad:
            raise ValueError(f"values unknown to the fit: {bad}")


def fit_features(train: DataFrame, features: list[str], target: str, config: FeatureConfig = FeatureConfig()) -> FittedFeatures:
    """Fit every step on the training rows only."""
    numeric, categorical = feature_roles(train, features)
    fitted = FittedFeatures(target, numeric, categorical, asdict(config))
    if config.null_policy == "fail":
        found = null_fail_fast(train, features).collect()
        if found:
            raise ValueError("missing values under policy fail: " + ", ".join(f"{r['column']}={r['nulls']}" for r in found))
    if config.null_policy == "impute":
        fitted.numeric_fill = numeric_fills(train, numeric, config.numeric_strategy, config.numeric_fill)
        fitted.categorical_fill = categorical_fills(train, categorical, config.categorical_strategy, config.categorical_fill)
    filled = nan_to_null(train).fillna(fitted.numeric_fill) if fitted.numeric_fill else train
    if config.scaling:
        fitted.scale = scale_stats(filled, numeric)
    if config.encoding:
        known = train.fillna(fitted.categorical_fill) if fitted.categorical_fill else train
        rare_below = config.min_frequency if config.encoding == "onehot" else None
        fitted.category = categories(known, categorical, config.max_categories, rare_below)
    return fitted


# --- statistics per split -------------------------------------------------------------------------------


def split_stats(df: DataFrame, columns: list[str], split: str) -> DataFrame:
    """(split, feature, rows, nulls, mean, std, min, max) of numeric columns from one pass, rounded to 6."""
    kinds = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    aggs = []
    for i, c in enumerate(columns):
        value = no_nan(df, c).cast("double")
        aggs.append(F.count_if(value.isNull()).alias(f"nulls_{i}"))
        aggs += [F.round(finite(f(value)), 6).alias(f"{n}_{i}") for n, f in kinds.items()]
    wide = df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("rows"), *aggs)
    parts = [F.col(f"{n}_{i}") for i in range(len(columns)) for n in ("nulls", *kinds)]
    width = 1 + len(kinds)
    pairs = [x for i, c in enumerate(columns) for x in (F.lit(c), *parts[i * width : (i + 1) * width])]
    return wide.select("split", "rows", F.stack(F.lit(len(columns)), *pairs).alias("feature", "nulls", *kinds))


def label_distribution(df: DataFrame, label: str, split: str) -> DataFrame:
    """(split, label, n) with missing labels counted."""
    return df.groupBy(F.col(split).alias("split"), F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: list[str], split: str, limit: int = TOP_VALUES) -> DataFrame:
    """(split, feature, value, n, place): the most frequent values per column; of equals the smaller first.

    Spark keeps only ``limit`` rows per group and task before it sorts, so a wide column is no burden.
    """
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    long = df.select(F.col(split).alias("split"), F.stack(F.lit(len(columns)), *pairs).alias("feature", "value"))
    counted = long.groupBy("split", "feature", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("split", "feature").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def label_index(train: DataFrame, label: str) -> DataFrame:
    """(label, class_index) from the sorted classes of the training rows."""
    return ordinal_table(train, label).select(F.col("value").alias("label"), F.col("code").alias("class_index"))


def with_class_index(df: DataFrame, label: str, index: DataFrame) -> DataFrame:
    """Rows with their class index; raises where a class is unknown, listing a few."""
    known = index.select(F.col("label").alias("_label"), "class_index")
    joined = df.join(known, df[label].cast("string") == F.col("_label"), "left").drop("_label")
    lost = joined.where(F.col("class_index").isNull()).select(F.col(label).cast("string").alias("v")).distinct().limit(10)
    bad = [r["v"] for r in lost.collect()]
    if bad:
        raise ValueError(f"classes not seen in training: {sorted(str(b) for b in bad)}")
    return joined


def flag_drifted(df: DataFrame, path: str, name: str = "is_drifted") -> DataFrame:
    """Whether the file's stem carries the mark of an added drifted item."""
    stem = F.regexp_extract(F.col(path), r"([^/]*?)(\.[^./]*)?$", 1)
    return df.withColumn(name, F.contains(stem, F.lit("_drifted")))
