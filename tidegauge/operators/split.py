"""Deterministic splits with exact shares per class, and sampling weights.

A row's place is the order of a seeded hash of its key inside its class. To cut a class at an exact rank
nothing is sorted as a whole: rows are counted by hash prefix, the one prefix that holds the cut is sorted,
and every row is then compared with the hash found there. A class with a third of all rows costs the same
as a small one. Rows with equal keys always land on the same side.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.columns import clip, half_even, hash_fraction, seeded_hash

PREFIX = 4  # hex digits of the hash: 65,536 groups per class
HASH = "_hash"
# Cuts of at most so many classes are sent to every task: a label and a few hashes each.
FEW_CLASSES = 100_000


def class_cuts(rows: DataFrame, strata: list[str], cuts: dict[str, Column], many_classes: bool = False) -> DataFrame:
    """One row per class with the hash of the row at each rank in ``cuts``; a class cut at rank 0 has none.

    ``rows`` has the hash column; a cut is an expression over the class size ``n`` and the class columns.
    ``many_classes`` as in ``take_per_class``.
    """
    prefix = F.substring(HASH, 1, PREFIX).alias("prefix")
    by_prefix = rows.groupBy(*strata, prefix).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*strata)
    before = whole.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_prefix.withColumns(
        {"n": F.sum("c").over(whole), "below": F.coalesce(F.sum("c").over(before), F.lit(0))}
    )
    for name, rank in cuts.items():
        placed = placed.withColumn(f"k_{name}", rank.cast("bigint"))
    holds = {n: (F.col("below") < F.col(f"k_{n}")) & (F.col(f"k_{n}") <= F.col("below") + F.col("c")) for n in cuts}
    hit = placed.where(reduce(lambda a, b: a | b, holds.values()))
    hit = hit.select(*strata, "prefix", "below", *[f"k_{n}" for n in cuts])
    hit = hit if many_classes else _few(hit, "below", FEW_CLASSES * len(cuts))
    inside = null_safe_join(rows.select(*strata, prefix, HASH), hit, strata + ["prefix"])
    place = F.col("below") + F.row_number().over(Window.partitionBy(*strata, "prefix").orderBy(HASH))
    ranked = inside.withColumn("place", place)
    found = ranked.groupBy(*strata).agg(
        *[F.max(F.when(F.col("place") == F.col(f"k_{n}"), F.col(HASH))).alias(f"cut_{n}") for n in cuts]
    )
    return found


def _few(table: DataFrame, column: str, bound: int) -> DataFrame:
    """``table`` to be broadcast; the job fails, before anything is sent, if it has more than ``bound`` rows.

    The rows counted are those of a limit one above the bound, so the count needs little memory whatever the table.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    refuse = F.raise_error(F.lit(f"more than {FEW_CLASSES} classes: pass many_classes=True"))
    return F.broadcast(table.limit(bound + 1).withColumn(column, F.when(n <= bound, F.col(column)).otherwise(refuse)))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a missing key matches a missing key, so rows without a class are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def _keyed(df: DataFrame, key: str | Column, seed: int) -> DataFrame:
    own = F.col(key) if isinstance(key, str) else key
    # Rows without a key would share one hash and land on one side together.
    refuse = F.raise_error(F.lit("rows to split need a key that is not null"))
    return df.withColumn(HASH, F.when(own.isNull(), refuse).otherwise(seeded_hash(seed, key)))


def _below(cut: str) -> Column:
    return F.coalesce(F.col(HASH) <= F.col(f"cut_{cut}"), F.lit(False))


def take_per_class(
    df: DataFrame,
    strata: list[str],
    key: str,
    seed: int,
    cuts: dict[str, Column],
    name: str,
    rest: str,
    many_classes: bool = False,
) -> DataFrame:
    """Label rows with the first cut they fall under, in the order of ``cuts``; the others get ``rest``.

    The cuts, one row per class, go to the rows, which stay where they are; this holds for ``FEW_CLASSES`` classes
    at most, checked when the job runs. With ``many_classes`` rows and cuts are shuffled by class instead, for any
    number of classes and with the same result. A null key fails the job.
    """
    rows = _keyed(df, key, seed)
    limits = class_cuts(rows, strata, cuts, many_classes)
    if not many_classes:
        limits = _few(limits, f"cut_{next(iter(cuts))}", FEW_CLASSES)
    label = F.lit(rest)
    for cut in reversed(list(cuts)):
        label = F.when(_below(cut), F.lit(cut)).otherwise(label)
    joined = null_safe_join(rows, limits, strata, "left")
    return joined.select(*df.columns, label.alias(name))


def _train_val_cuts(train_ratio: float, val_ratio: float) -> dict[str, Column]:
    n = F.col("n")
    train = half_even(n * F.lit(train_ratio))
    return {"train": train, "val": F.least(n, train + half_even(n * F.lit(val_ratio)))}


def split_stratified(
    df: DataFrame,
    label: str,
    key: str,
    seed: int = 42,
    train_ratio: float = 0.70,
    val_ratio: float = 0.15,
    many_classes: bool = False,
) -> DataFrame:
    """Add ``split`` = train, val or test with each class's shares cut exactly (half-even rounding)."""
    _check_ratios(train_ratio, val_ratio)
    return take_per_class(df, [label], key, seed, _train_val_cuts(train_ratio, val_ratio), "split", "test", many_classes)


def split_random(df: DataFrame, key: str, seed: int = 42, train_ratio: float = 0.70, val_ratio: float = 0.15) -> DataFrame:
    """Add ``split`` by the hash alone: no shuffle, shares hold in expectation."""
    _check_ratios(train_ratio, val_ratio)
    u = hash_fraction(seeded_hash(seed, key))
    return df.withColumn(
        "split", F.when(u < train_ratio, "train").when(u < train_ratio + val_ratio, "val").otherwise("test")
    )


def _check_ratios(train_ratio: float, val_ratio: float) -> None:
    if not 0.0 < train_ratio < 1.0 or not 0.0 <= val_ratio < 1.0 or train_ratio + val_ratio > 1.0:
        raise ValueError(f"train ratio {train_ratio} and val ratio {val_ratio} do not make a split")


def split_preserving_test(
    df: DataFrame,
    label: str,
    name: str,
    key: str,
    seed: int = 42,
    train_ratio: float = 0.70,
    val_ratio: float = 0.15,
    many_classes: bool = False,
) -> DataFrame:
    """Keep a split that the item names spell out (``train_…`` and ``test_…`` only, both present): test stays,
    val is cut from train per class. Any other naming gets the ordinary stratified split."""
    lower = F.lower(F.col(name))
    is_train, is_test = lower.startswith("train_"), lower.startswith("test_")
    facts = df.agg(F.bool_and(is_train | is_test) & F.bool_or(is_train) & F.bool_or(is_test)).scalar()
    named = df.withColumns({"_keep": F.coalesce(facts, F.lit(False)), "_side": F.when(is_test, "test").otherwise("train")})
    # one group per class, or per class and named side when the naming is kept
    side = F.when(F.col("_keep"), F.col("_side")).otherwise("any")
    rows = named.withColumn("_group", side)
    n = F.col("n")
    kept, as_train = F.col("_group") != "any", F.col("_group") == "train"
    plain = _train_val_cuts(train_ratio, val_ratio)
    cuts = {
        "val": F.when(as_train, half_even(n * F.lit(max(val_ratio, 0.0)))).when(kept, F.lit(0)).otherwise(
            half_even(n * F.lit(val_ratio))
        ),
        "train": F.when(as_train, n).when(kept, F.lit(0)).otherwise(F.least(n, half_even(n * F.lit(val_ratio)) + plain["train"])),
    }
    return take_per_class(rows, [label, "_group"], key, seed, cuts, "split", "test", many_classes).drop("_keep", "_side", "_group")


def split_profile(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """(split, label, n, share): counts per split and label, with the totals where the label is null.

    The share is that of the split in all rows for totals, and of the label in its split otherwise.
    """
    counted = df.groupBy(F.col(split).alias("split"), F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    rolled = counted.rollup("split", "label").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    rolled = rolled.where("g < 3")
    per_level = Window.partitionBy("g", F.when(F.col("g") == 0, F.col("split")))
    share = F.round(F.col("n") / F.sum("n").over(per_level), 4)
    return rolled.select("split", "label", F.col("g").cast("int").alias("level"), "n", share.alias("share"))


def _held_out(ratio: float) -> Column:
    """At least one, never all: min(max(1, round(n·r)), n - 1)."""
    n = F.col("n")
    return F.least(F.greatest(F.lit(1), half_even(n * F.lit(ratio))), n - 1)


def holdout_stratified(
    df: DataFrame, label: str, key: str, ratio: float, seed: int = 42, many_classes: bool = False
) -> DataFrame:
    """Add ``part`` = holdout or train; a class with a single row stays in train."""
    return take_per_class(df, [label], key, seed, {"holdout": _held_out(ratio)}, "part", "train", many_classes)


def holdout_tabular(
    df: DataFrame,
    label: str,
    key: str,
    ratio: float,
    task_type: str = "classification",
    seed: int = 42,
    many_classes: bool = False,
) -> DataFrame:
    """Add ``part`` with the ratio held so that both sides get a row; stratified for classification, unless a
    class has a single row. Needs two rows."""
    classes = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("c"))
    facts = classes.agg(F.sum("c").alias("n"), F.min("c").alias("least")).first()
    total = facts["n"] or 0
    if total < 2:
        raise ValueError(f"a holdout needs at least 2 rows, got {total}")
    ratio = max(1 / total, min(ratio, (total - 1) / total))
    if task_type == "classification" and facts["least"] >= 2:
        cut = F.least(half_even(F.col("n") * F.lit(ratio)), F.col("n") - 1)
        return take_per_class(df, [label], key, seed, {"holdout": cut}, "part", "train", many_classes)
    rows = _keyed(df, key, seed).withColumn("_all", F.lit(1))
    cut = clip(half_even(F.col("n") * F.lit(ratio)), 1, total - 1)
    limit = class_cuts(rows, ["_all"], {"holdout": cut}).select("cut_holdout").scalar()
    return rows.select(*df.columns, F.when(F.col(HASH) <= limit, "holdout").otherwise("train").alias("part"))


def drift_val_slice(
    df: DataFrame, label: str, is_drifted: str, key: str, ratio: float, seed: int = 42, many_classes: bool = False
) -> DataFrame:
    """The drifted rows set aside per class to watch adaptation; a class with one drifted row gives none."""
    drifted = df.where(F.col(is_drifted))
    cut = F.when(F.col("n") > 1, _held_out(ratio)).otherwise(F.lit(0))
    parted = take_per_class(drifted, [label], key, seed, {"take": cut}, "_part", "leave", many_classes)
    return parted.where("_part = 'take'").drop("_part")


def oversample_weights(df: DataFrame, is_drifted: str, target_ratio: float) -> DataFrame:
    """Add ``weight`` so that drifted rows make up ``target_ratio`` of a weighted draw."""
    drifted = F.col(is_drifted)
    counts = df.agg(F.struct(F.count_if(drifted).alias("d"), F.count_if(~drifted).alias("c"))).scalar()
    d, c = counts["d"], counts["c"]
    odds = F.lit(target_ratio / (1.0 - target_ratio))
    weight = F.when(drifted & (d > 0) & (c > 0), odds * c / F.nullif(d, F.lit(0))).otherwise(1.0)
    return df.withColumn("weight", weight)


# Hexadecimal digits of a hash that one level of the draw's tree takes, and the rows a group at its foot may hold.
TREE_DIGITS = 3
LEAF_ROWS = 50_000
WHOLE_WEIGHT = 2**40  # the largest weight as a whole number, so that sums do not depend on their order


def _shared_out(n: int, weights: list[int], *seed: int | str) -> list[int]:
    """How many of ``n`` draws fall to each weight: a multinomial by conditional binomials, fixed by its seed."""
    draw = np.random.default_rng(list(hashlib.sha256(":".join(map(str, seed)).encode()).digest()))
    left, rest, out = int(n), sum(weights), []
    for w in weights:
        share = 0 if not left or not w else left if w == rest else int(draw.binomial(left, w / rest))
        out.append(share)
        left, rest = left - share, rest - w
    return out


def weighted_resample(
    df: DataFrame, weight: str, key: str, size: int, seed: int = 42, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Exactly ``size`` rows drawn from ``df`` with replacement, each draw by weight; ``copy_no`` numbers a row's copies.

    The draws go down a tree over the seeded hashes of the keys. At each node they are shared out among its branches
    by the sums of their weights (conditional binomials, so the whole is one multinomial), at the foot among rows. The
    driver shares out over the first 4096 branches; below, each group has at most 4096 branches or about ``leaf_rows``
    rows, and a node's random numbers depend on the seed and its place only. So the result depends neither on
    partitions nor on lost executors. Weights count as whole numbers of 2^-40 of the largest; null, NaN, negative and
    zero weights are never drawn. Without any weight there are no rows. Keys name rows: rows with one key stay together.
    """
    w = F.col(weight).cast("double")
    usable = F.when(~F.isnan(w) & (w > 0) & (w < float("inf")), w)
    most, rows = df.agg(F.max(usable), F.count(usable)).first()
    empty = df.withColumn("copy_no", F.lit(1)).where("false")
    if not rows or size <= 0:
        return empty
    levels = 1
    while rows > leaf_rows * 16 ** (TREE_DIGITS * levels):
        levels += 1
    whole = F.coalesce(F.floor(usable / F.lit(most) * F.lit(float(WHOLE_WEIGHT))), F.lit(0)).cast("decimal(38,0)")
    kept = df.withColumns({"_w": whole, "_h": seeded_hash(seed, key)}).where("_w > 0")

    def sums(level: int) -> DataFrame:
        return kept.groupBy(F.substring("_h", 1, TREE_DIGITS * level).alias("_p")).agg(F.sum("_w").alias("_w"))

    top = sorted((r["_p"], int(r["_w"])) for r in sums(1).collect())  # at most 4096 rows
    shares = _shared_out(size, [w for _, w in top], seed, "root")
    drawn = df.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(top, shares) if n], "_p string, _n long")
    for level in range(2, levels + 1):

        def branch(group: pa.Table) -> pa.Table:
            group = group.sort_by("_p")
            found = _shared_out(group["_n"][0].as_py(), [int(x) for x in group["_w"].to_pylist()], seed, group["_up"][0].as_py())
            return pa.table({"_p": group["_p"], "_n": pa.array(found, pa.int64())}).filter(pc.greater(pa.array(found), 0))

        up = sums(level).withColumn("_up", F.substring("_p", 1, TREE_DIGITS * (level - 1)))
        drawn = up.join(drawn.withColumnRenamed("_p", "_up"), "_up").groupBy("_up").applyInArrow(branch, "_p string, _n long")

    def foot(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_h", "ascending"), ("_w", "ascending"), ("_row", "ascending")])
        found = _shared_out(group["_n"][0].as_py(), [int(x) for x in group["_w"].to_pylist()], seed, group["_p"][0].as_py())
        return group.select(columns).append_column("_k", pa.array(found, pa.int64())).filter(pc.greater(pa.array(found), 0))

    columns = df.columns
    placed = kept.withColumns({"_p": F.substring("_h", 1, TREE_DIGITS * levels), "_row": F.xxhash64(*columns)})
    schema = T.StructType([*df.schema.fields, T.StructField("_k", T.LongType())])
    taken = placed.join(drawn, "_p").groupBy("_p").applyInArrow(foot, schema)
    return taken.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int")))).drop("_k")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_all / (classes x n_class)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("t"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("weight", whole["t"] / (whole["k"] * F.col("n")))


def with_class_weight(df: DataFrame, label: str, name: str = "weight", many_classes: bool = False) -> DataFrame:
    """Every row with its class's balanced weight, for ``weightCol``; ``many_classes`` as in ``take_per_class``."""
    weights = class_weights(df, label).select(F.col("label").alias("_label"), F.col("weight").alias(name))
    weights = weights if many_classes else _few(weights, name, FEW_CLASSES)
    return df.join(weights, df[label].eqNullSafe(F.col("_label")), "left").drop("_label")
