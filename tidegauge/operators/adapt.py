"""Drift-adaptive data preparation: staging, attempts, exact rollback and safe names.

Datasets are never changed in place. An attempt adds tagged rows; a rollback is a new version without them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import seeded_hash
from tidegauge.operators.fingerprint import dataset_fingerprint
from tidegauge.operators.ordered import BUCKET, running_sums
from tidegauge.operators.split import HASH, PREFIX, holdout_tabular, null_safe_join

NUMBERS_PER_BUCKET = 65_536
ITEMS_PER_TASK = 1_000_000


def append_training_rows(dataset: DataFrame, added: DataFrame) -> DataFrame:
    """The dataset with the new rows; both must have the same columns in the same order."""
    if dataset.columns != added.columns:
        raise ValueError(f"columns {added.columns} do not match the dataset's {dataset.columns}")
    return dataset.unionByName(added)


def append_report(dataset: DataFrame, added: DataFrame) -> DataFrame:
    """(stage, version, row_count) before and after, so that a new fingerprint shows the new content."""
    after = append_training_rows(dataset, added)
    return (
        dataset_fingerprint(dataset)
        .withColumn("stage", F.lit("before"))
        .unionByName(dataset_fingerprint(after).withColumn("stage", F.lit("after")))
    )


@dataclass
class StagedBatch:
    """What staging a labelled drifted batch gives: the holdout and the rows to train on."""

    holdout: DataFrame
    train: DataFrame
    merged: DataFrame


def stage_batch(
    dataset: DataFrame, drifted: DataFrame, target: str, key: str, ratio: float, task_type: str = "classification", seed: int = 42
) -> StagedBatch:
    """Check a labelled drifted batch, set a holdout aside and add the rest to the dataset."""
    missing = sorted(set(dataset.columns) - set(drifted.columns))
    if missing:
        raise ValueError(f"the drifted batch lacks columns {missing}")
    if not 0.0 < ratio <= 0.9:
        ratio = min(max(ratio, 1e-9), 0.9)
    parts = holdout_tabular(drifted.select(*dataset.columns), target, key, ratio, task_type, seed)
    holdout = parts.where("part = 'holdout'").drop("part")
    train = parts.where("part = 'train'").drop("part")
    return StagedBatch(holdout, train, append_training_rows(dataset, train))


def write_holdout(holdout: DataFrame, baseline: DataFrame, root: str, dataset: str) -> None:
    """Store a dataset's holdout and the baseline metrics measured on it, replacing only that dataset's."""
    for df, name in ((holdout, "holdout"), (baseline, "baseline_metrics")):
        writer = df.withColumn("dataset", F.lit(dataset)).write.partitionBy("dataset").mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{root}/{name}")


def read_holdout(spark: SparkSession, root: str, dataset: str) -> tuple[DataFrame, DataFrame] | None:
    """The stored holdout and baseline, or None where the dataset has none."""
    try:
        found = [spark.read.parquet(f"{root}/{n}").where(F.col("dataset") == dataset).drop("dataset") for n in ("holdout", "baseline_metrics")]
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return None if found[0].isEmpty() else (found[0], found[1])


def attempt_items(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """The manifest that ``items`` (attempt_id, class, path) and ``attempts`` (keys…, attempt_id) make: a row per added item,
    tagged with its attempt and the attempt's keys. An attempt that is listed several times has its items as often.

    Items are counted first, so that a task joins about ITEMS_PER_TASK of them however many there are.
    """
    tasks = max(1, -(-items.count() // ITEMS_PER_TASK))
    return items.repartition(tasks, "attempt_id").join(attempts.repartition(tasks, "attempt_id"), "attempt_id")


def attempt_summary(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, attempt_id, class, n_items, n_items_added): counts per class and for the attempt.

    ``manifest`` has a row per added item (keys…, attempt_id, class, path); lists stay rows. The sum of an attempt is joined
    to its classes in a stage of its own, so the tasks that count hold nothing else.
    """
    attempt = [*keys, "attempt_id"]
    per_class = manifest.groupBy(*attempt, "class").agg(F.count("*").alias("n_items"))
    whole = per_class.groupBy(*attempt).agg(F.sum("n_items").alias("n_items_added"))
    return null_safe_join(per_class, whole, attempt)


def counted_attempts(items: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """``attempt_summary`` of the manifest that ``items`` and ``attempts`` make."""
    return attempt_summary(attempt_items(items, attempts), keys)


def choose_attempts(manifest: DataFrame, keys: list[str], which: str) -> DataFrame:
    """The items of all attempts, of each dataset's latest one, or of the attempt with the given id."""
    if which == "all":
        return manifest
    if which == "latest":
        top = manifest.groupBy(*keys).agg(F.max("attempt_id").alias("attempt_id"))
        return manifest.join(top, [*keys, "attempt_id"], "left_semi")
    return manifest.where(F.col("attempt_id").cast("string") == which)


def rolled_back(dataset: DataFrame, chosen: DataFrame, item: list[str]) -> DataFrame:
    """The dataset without exactly the chosen items."""
    return dataset.join(chosen.select(*item).distinct(), item, "left_anti")


def rollback_report(dataset: DataFrame, chosen: DataFrame, item: list[str], by: list[str]) -> DataFrame:
    """(by…, removed, missing): recorded items still there, and those gone already."""
    there = dataset.select(*item).distinct().withColumn("_there", F.lit(True))
    marked = chosen.join(there, item, "left")
    return marked.groupBy(*by).agg(
        F.count_if(F.col("_there").isNotNull()).alias("removed"), F.count_if(F.col("_there").isNull()).alias("missing")
    )


# --- collision-free names -------------------------------------------------------------------------------


def _name_parts(name: Column) -> tuple[Column, Column]:
    return F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)


SMALL_GROUP = 10_000  # names and taken numbers of a group that one window numbers


def _numbered(rows: DataFrame, taken: DataFrame, group: list[str]) -> DataFrame:
    """(group…, path, number) of groups of any size, by tasks that hold a hash prefix or a span of numbers each."""
    # place of each new item in its group: count by hash prefix, then number inside the prefix
    prefixed = rows.withColumn("prefix", F.substring(HASH, 1, PREFIX))
    per_prefix = prefixed.groupBy(*group, "prefix").agg(F.count("*").alias("c"))
    before = Window.partitionBy(*group).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_prefix.select(*group, "prefix", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*group, "prefix").orderBy(HASH, "path"))
    placed = null_safe_join(prefixed, starts, [*group, "prefix"]).select(
        *group, "path", (F.col("start") + inside - 1).cast("bigint").alias("at")
    )
    spans = taken.withColumn(BUCKET, F.floor(F.col("t") / NUMBERS_PER_BUCKET))
    ranked = running_sums(spans, group, [F.col("t").asc()], {"r": F.lit(1)}, bucketed=True)
    # a free number for place k is k plus the taken numbers t with t - rank(t) <= k, counted in order
    marks = ranked.select(*group, F.lit(None).cast("string").alias("path"), (F.col("t") - F.col("r") + 1).alias("at"), F.lit(1).alias("is_taken"))
    both = marks.unionByName(placed.withColumn("is_taken", F.lit(0))).withColumn(BUCKET, F.floor(F.col("at") / NUMBERS_PER_BUCKET))
    order = [F.col("at").asc(), F.col("is_taken").desc()]
    counted = running_sums(both, group, order, {"used": F.col("is_taken")}, bucketed=True).where("is_taken = 0")
    return counted.select(*group, "path", (F.col("at") + F.col("used")).alias("number"))


def _numbered_small(rows: DataFrame, taken: DataFrame, group: list[str]) -> DataFrame:
    """As ``_numbered``, for groups that fit one window: the free numbers of a group are the first not taken, and its
    items take them in order of their hash."""
    held = taken.groupBy(*group).agg(F.array_sort(F.collect_list("t")).alias("held"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(HASH, "path")) - 1
    # the place below which each taken number pushes no item: t minus the taken numbers before it
    pushes = F.transform("held", lambda t, i: t - i)
    known = null_safe_join(rows.withColumn("at", place), held.withColumn("pushes", pushes), group, "left")
    used = F.coalesce(F.size(F.filter("pushes", lambda x: x <= F.col("at"))), F.lit(0))
    return known.select(*group, "path", (F.col("at") + used).cast("bigint").alias("number"))


def safe_names(new: DataFrame, existing: DataFrame, seed: int = 0) -> DataFrame:
    """(class, path, new_name): ``stem_drifted.ext``, or the first free ``stem_drifted_N.ext``.

    ``new`` is (class, path), ``existing`` (class, name). Items of one class with equal names take the free
    numbers one by one, in order of a hash of their path. One count per name decides the way: a name that one item
    wants and nothing holds is a projection of that count; names up to SMALL_GROUP items and taken numbers are
    numbered by one window each; a name that very many items share is numbered by many tasks. Repeated items each
    get a name of their own; an item without a path has none.
    """
    group = ["class", "stem", "ext"]
    file = F.regexp_extract("path", r"([^/]*)$", 1)
    stem, ext = _name_parts(file)
    named = new.where(F.col("path").isNotNull()).select("class", "path", stem.alias("stem"), ext.alias("ext"))
    rows = named.withColumn(HASH, seeded_hash(seed, "path"))
    # numbers taken already: 0 stands for the name without a number
    old_stem, old_ext = _name_parts(F.col("name"))
    mark = r"^(.*)_drifted(?:_([1-9][0-9]*))?$"
    taken = (
        existing.select("class", old_stem.alias("s"), old_ext.alias("ext"))
        .where(F.rlike("s", F.lit(mark)))
        .select(
            "class",
            F.regexp_extract("s", mark, 1).alias("stem"),
            "ext",
            F.coalesce(F.nullif(F.regexp_extract("s", mark, 2), F.lit("")), F.lit("0")).cast("bigint").alias("t"),
        )
        .distinct()
    )
    wanted = named.withColumn("_new", F.lit(1)).unionByName(
        taken.select(*group, F.lit(None).cast("string").alias("path"), F.lit(0).alias("_new"))
    )
    sizes = wanted.groupBy(*group).agg(F.sum("_new").alias("k"), F.count("*").alias("both"), F.max("path").alias("path"))
    free = sizes.where("k = 1 and both = 1").select("class", "path", F.concat("stem", F.lit("_drifted"), "ext").alias("new_name"))

    # only a count tells whether the long way is needed; where it is not, its plan is not built
    many = f"both > {SMALL_GROUP}"
    is_long = not sizes.where("k > 0").where(many).isEmpty()
    few = sizes.where("k > 0 and both > 1" + (f" and not {many}" if is_long else "")).select(*group)
    met = _numbered_small(null_safe_join(rows, few, group, "left_semi"), taken, group)
    if is_long:
        long = sizes.where("k > 0").where(many).select(*group)
        met = met.unionByName(_numbered(null_safe_join(rows, long, group, "left_semi"), taken, group))
    suffix = F.when(F.col("number") > 0, F.concat(F.lit("_"), F.col("number").cast("string"))).otherwise(F.lit(""))
    return free.unionByName(met.select("class", "path", F.concat("stem", F.lit("_drifted"), suffix, "ext").alias("new_name")))


def adaptation_due(runs: DataFrame, staged: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Runs (run_id, dataset, task_type, fine_tune) that must compare before and after.

    Tabular runs need a staged batch that was not evaluated yet, image runs a fine-tune. A staged batch is
    evaluated once.
    """
    pending = staged.join(evaluated, ["dataset", "staged_id"], "left_anti").select("dataset").distinct()
    is_image = F.startswith("task_type", F.lit("image"))
    tabular = runs.where(~is_image).join(pending, "dataset", "left_semi")
    return tabular.unionByName(runs.where(is_image & F.col("fine_tune")))
