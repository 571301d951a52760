"""Two-sample distances of many batches against one reference, in one plan.

Both sides are reduced to value counts before anything is compared, so a value that fills a third of the
rows is one row afterwards. The reference is never copied per batch: every statistic is written so that it
needs the reference only at the values a batch has. Branches of a plan start from the same unfiltered
counts, so Spark computes that shuffle once and reuses it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import DriftConfig
from tidegauge.functions.columns import finite, unpivot
from tidegauge.functions.stats import chi_square_p, kolmogorov_p
from tidegauge.operators.ordered import BUCKET, bucket_edges, thinned, with_bucket
from tidegauge.session import bucket_count, plan_bytes

FEATURE, VALUE, BATCH = "feature", "value", "batch"
KEY = [FEATURE, BATCH]
SALT = "_salt"
RANK_BUCKETS = 256  # at least so many; larger inputs get as many as their values have buckets


# --- value counts ---------------------------------------------------------------------------------------


def long_form(reference: DataFrame, batches: DataFrame, features: list[str], batch: str, as_type: str) -> DataFrame:
    """(feature, batch, value) of both sides; batch is null for the reference. Infinite numbers count as missing."""
    ref = unpivot(reference, [], features, as_type, finite_only=True).select(FEATURE, F.lit(None).cast("string").alias(BATCH), VALUE)
    named = batches.where(F.col(batch).isNotNull()).select(
        F.col(batch).cast("string").alias(BATCH), *[F.col(c) for c in features if c != BATCH]
    )
    return ref.unionByName(unpivot(named, [BATCH], features, as_type, finite_only=True).select(FEATURE, BATCH, VALUE))


def counts_of(long: DataFrame) -> DataFrame:
    """(feature, batch, value, n_ref, n_cur): one row per distinct value of a side.

    There is one aggregate only, so column pruning cannot make branches differ that share this shuffle.
    """
    counted = long.groupBy(FEATURE, BATCH, VALUE).agg(F.count("*").alias("n"))
    is_ref, none = F.col(BATCH).isNull(), F.lit(0).cast("bigint")
    return counted.select(
        FEATURE,
        BATCH,
        VALUE,
        F.when(is_ref, F.col("n")).otherwise(none).alias("n_ref"),
        F.when(is_ref, none).otherwise(F.col("n")).alias("n_cur"),
    )


def value_counts(reference: DataFrame, batches: DataFrame, features: list[str], batch: str, as_type: str) -> DataFrame:
    return counts_of(long_form(reference, batches, features, batch, as_type))


@dataclass(frozen=True)
class Samples:
    """Value counts with a thinned copy of the rows behind them, from which cut points are drawn.

    ``tasks`` deals the buckets over so many tasks, where their rows were counted and the session has fewer.
    """

    counts: DataFrame
    thin: DataFrame | None = None
    buckets: int | None = None
    salts: int = 1
    tasks: int | None = None

    def bucket_number(self) -> int:
        return bucket_count(self.counts) if self.buckets is None else self.buckets

    def placed(self) -> tuple[DataFrame, bool]:
        """The counts with their ordered bucket, and whether there is more than one."""
        rows = self.counts if self.thin is None else self.thin
        edges = bucket_edges(rows, [FEATURE], VALUE, self.bucket_number())
        return with_bucket(self.counts, edges, [FEATURE], VALUE), edges is not None

    def spread(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows of a key together, over as many tasks as were asked for; else as the session has it."""
        return rows if self.tasks is None else rows.repartition(self.tasks, *keys)


def salt_number(reference: DataFrame, batches: DataFrame) -> int:
    """Over how many parts the batches are dealt, each with a copy of the reference: as often as the batches are larger
    than the reference, so that the copies take no more room than the batches, and at most once per shuffle partition."""
    ref, cur = plan_bytes(reference), plan_bytes(batches)
    if not ref or not cur:
        return 1
    most = int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return int(max(1, min(most, cur // ref)))


def dealt(rows: DataFrame, salts: int) -> DataFrame:
    """Rows with their salt: one per batch, and for the reference's rows (batch null) every one in turn."""
    if salts <= 1:
        return rows.withColumn(SALT, F.lit(0))
    own = F.array(F.pmod(F.xxhash64(BATCH), F.lit(salts)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return rows.withColumn(SALT, F.explode(F.when(F.col(BATCH).isNull(), every).otherwise(own)))


def samples(
    reference: DataFrame, batches: DataFrame, features: list[str], batch: str, buckets: int | None = None, salts: int | None = None
) -> Samples:
    """Counts of numeric features, ready for the distances over ordered values."""
    counts = value_counts(reference, batches, features, batch, "double")
    number = bucket_count(reference, batches) if buckets is None else buckets
    thin = None if number <= 1 else long_form(thinned(reference), thinned(batches), features, batch, "double")
    return Samples(counts, thin, number, salt_number(reference, batches) if salts is None else salts)


def bin_counts(reference: DataFrame, batches: DataFrame, features: list[str], batch: str, bins: int) -> DataFrame:
    """Counts of equal-width bins over the reference's range; outside values go to the edge bins.

    The range comes from one small aggregate, so rows are binned before the shuffle and each task sends
    at most ``bins`` rows per feature and batch.
    """
    span = reference.agg(
        *[f(finite(F.col(c).cast("double"))).alias(f"{c}_{n}") for c in features for n, f in _ENDS.items()]
    )
    rows = [F.struct(F.lit(c).alias(FEATURE), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi")) for c in features]
    span = span.select(F.inline(F.array(*rows)))
    return bin_long(long_form(reference, batches, features, batch, "double"), span, bins)


_ENDS: dict[str, Callable[[Column], Column]] = {"lo": F.min, "hi": F.max}


def bin_long(long: DataFrame, span: DataFrame, bins: int) -> DataFrame:
    """Bin counts of a long table; ``span`` has one row (feature, lo, hi) per feature."""
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    place = F.floor((F.col(VALUE) - F.col("lo")) / width * bins)
    place = F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)), F.lit(0))
    binned = long.join(F.broadcast(span), FEATURE)  # as many rows as there are feature columns
    return counts_of(binned.select(FEATURE, BATCH, place.cast("string").alias(VALUE)))


def reference_moments(counts: DataFrame) -> DataFrame:
    """(feature, ref_mean, ref_std): mean and population standard deviation from the value counts."""
    n = F.nullif(F.sum("n_ref").cast("double"), F.lit(0.0))
    first = counts.groupBy(FEATURE).agg((F.sum(F.col("n_ref") * F.col(VALUE)) / n).alias("ref_mean"))
    squared = F.col("n_ref") * F.pow(F.col(VALUE) - F.col("ref_mean"), 2)
    return (
        counts.join(F.broadcast(first), FEATURE)
        .groupBy(FEATURE)
        .agg(F.first("ref_mean").alias("ref_mean"), F.sqrt(F.sum(squared) / n).alias("ref_std"))
    )


# --- distances over ordered values ----------------------------------------------------------------------


def cumulative(data: Samples, of_reference: bool = True) -> tuple[DataFrame, bool]:
    """The counts with both cumulative counts up to (``_le``) and below (``_lt``) each value, and both sizes n and m.

    ``ref_mass`` is the reference's running sum of value x count, for areas under its distribution function.

    Windows run over (feature, salt, bucket): a salt holds a part of the batches and the reference's values, so
    neither many batches nor one value that all of them have gathers in one task. ``of_reference`` keeps the reference's
    rows. With more than one bucket, what lies
    before a bucket and the sizes enter the windows as rows of their own that sort first, so nothing is joined.
    """
    placed, bucketed = data.placed()
    is_ref = F.col(BATCH).isNull()
    rows = placed.withColumn("mass", F.when(is_ref, F.col("n_ref") * F.col(VALUE)).otherwise(0.0))
    if bucketed:
        none = F.lit(None).cast("bigint")
        rows = rows.withColumns({"n_all": none, "m_all": none}).unionByName(_earlier_buckets(rows))
    group, whole = [FEATURE, SALT, BUCKET], (Window.unboundedPreceding, Window.unboundedFollowing)
    rows = data.spread(dealt(rows, data.salts), *group)
    # the reference's row of a value comes first, so a batch row sees it in its running sums
    merged = Window.partitionBy(*group).orderBy(F.col(VALUE).asc_nulls_first(), F.col(BATCH).asc_nulls_first())
    own = Window.partitionBy(*group, BATCH).orderBy(F.col(VALUE).asc_nulls_first())
    so_far = (Window.unboundedPreceding, Window.currentRow)
    ref, cur = merged.rowsBetween(*so_far), own.rowsBetween(*so_far)
    known = is_ref & F.col(VALUE).isNotNull()
    seen = {"seen": F.last(F.when(known, F.col(VALUE)), True), "times": F.last(F.when(known, F.col("n_ref")), True)}
    n = F.max("n_all").over(ref) if bucketed else F.sum("n_ref").over(merged.rowsBetween(*whole))
    m = F.max("m_all").over(cur) if bucketed else F.sum("n_cur").over(own.rowsBetween(*whole))
    curves = rows.withColumns(
        {"ref_le": F.sum("n_ref").over(ref), "ref_mass": F.sum("mass").over(ref), "n": n} | {k: c.over(ref) for k, c in seen.items()}
    )
    curves = curves if of_reference else curves.where(~is_ref)
    curves = curves.withColumns({"cur_le": F.sum("n_cur").over(cur), "m": m})
    here = F.when(F.col("seen") == F.col(VALUE), F.col("times")).otherwise(F.lit(0))
    return curves.where(F.col(VALUE).isNotNull() & (F.col("n") > 0)).select(
        *KEY,
        SALT,
        BUCKET,
        VALUE,
        "ref_le",
        (F.col("ref_le") - here).alias("ref_lt"),
        "ref_mass",
        "cur_le",
        (F.col("cur_le") - F.col("n_cur")).alias("cur_lt"),
        "n",
        F.coalesce("m", F.lit(0)).alias("m"),
    ), bucketed


def _earlier_buckets(rows: DataFrame) -> DataFrame:
    """A row without a value per (feature, bucket, batch): the counts of the buckets before it and the sizes in all.

    The reference has one for each bucket of a feature, also where it has no value there itself.
    """
    sums = {c: F.sum(c).alias(c) for c in ("n_ref", "mass", "n_cur")}
    totals = rows.groupBy(*KEY, BUCKET).agg(*sums.values())
    long, real = F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def before(c: str, keys: list[str]) -> Column:
        return F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def over_all(c: str, keys: list[str]) -> Column:
        return F.sum(c).over(Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    ref = totals.groupBy(FEATURE, BUCKET).agg(sums["n_ref"], sums["mass"]).select(
        FEATURE,
        F.lit(None).cast("string").alias(BATCH),
        real.alias(VALUE),
        before("n_ref", [FEATURE]).alias("n_ref"),
        F.lit(0).cast("bigint").alias("n_cur"),
        BUCKET,
        before("mass", [FEATURE]).cast("double").alias("mass"),
        over_all("n_ref", [FEATURE]).alias("n_all"),
        long.alias("m_all"),
    )
    cur = totals.select(
        *KEY,
        real.alias(VALUE),
        F.lit(0).cast("bigint").alias("n_ref"),
        before("n_cur", KEY).alias("n_cur"),
        BUCKET,
        F.lit(0.0).alias("mass"),
        long.alias("n_all"),
        over_all("n_cur", KEY).alias("m_all"),
    )
    # only batches have a size: a filter on BATCH would go down to the scan, and the counts be made again for these rows
    return ref.unionByName(cur.where("m_all > 0"))


def ks(data: Samples) -> DataFrame:
    """(feature, batch, statistic, p_value, n, m): largest gap of the two distribution functions.

    It sits at a value of the batch or just below one, because the batch's curve is flat and the
    reference's only rises in between.
    """
    curves, _ = cumulative(data, of_reference=False)
    n, m = F.col("n"), F.col("m")
    gap = F.greatest(
        F.abs(F.col("ref_le") / n - F.col("cur_le") / m), F.abs(F.col("ref_lt") / n - F.col("cur_lt") / m)
    )
    d = curves.groupBy(*KEY).agg(F.max(gap).alias("statistic"), F.max("n").alias("n"), F.max("m").alias("m"))
    return d.select(*KEY, "statistic", kolmogorov_p(F.col("statistic"), n, m).alias("p_value"), "n", "m")


def wasserstein(data: Samples) -> DataFrame:
    """(feature, batch, statistic, scaled): area between the two distribution functions, also over the
    reference's population standard deviation (1 where that is 0).

    Between two neighbouring values of a batch its curve is a constant g. There the area follows from
    A(x), the area under the reference's curve up to x, at both ends and at q, the reference's g-quantile,
    when q lies inside. Quantiles are found by rank, so reference rows are not repeated per batch, and all
    rows run through one chain of windows.
    """
    n, m, nxt = F.col("n"), F.col("m"), F.col("nxt")
    share = F.col("cur_le") / F.nullif(m, F.lit(0).cast("bigint"))
    steps = _neighbours(data, *cumulative(data)).select(
        *KEY,
        SALT,
        VALUE,
        "ref_lt",
        "ref_le",
        "cur_le",
        "n",
        "m",
        F.col("prev_value").isNull().alias("is_first"),
        nxt[VALUE].alias("next_value"),
        share.alias("g"),
        ((F.col(VALUE) * F.col("ref_le") - F.col("ref_mass")) / n).alias("a0"),
        ((nxt[VALUE] * nxt["ref_le"] - nxt["ref_mass"]) / n).alias("a1"),
        F.coalesce((F.col("ref_le") / n < share) & (nxt["ref_lt"] / n > share), F.lit(False)).alias("crosses"),
    )
    placed = _with_quantile(data, steps, max(RANK_BUCKETS, data.bucket_number()))
    # below the first value of the batch, then the piece up to the next value, or what lies above the last
    head = F.when(F.col("is_first"), F.col("a0")).otherwise(F.lit(0.0))
    flat = F.abs(F.col("a1") - F.col("a0") - F.col("g") * (F.col("next_value") - F.col(VALUE)))
    crossed = (
        F.col("a0")
        + F.col("a1")
        - 2.0 * F.col("at.area")
        + F.col("g") * (2.0 * F.col("at.q") - F.col(VALUE) - F.col("next_value"))
    )
    tail = F.col("a0") - F.col(VALUE)  # the reference mean is added once, below
    piece = F.when(F.col("next_value").isNull(), tail).when(F.col("crosses"), crossed).otherwise(flat)
    area = placed.where(F.col(BATCH).isNotNull()).groupBy(*KEY).agg(F.sum(head + piece).alias("area"))
    scale = F.when(F.col("ref_std") > 0, F.col("ref_std")).otherwise(F.lit(1.0))
    return (
        area.join(F.broadcast(reference_moments(data.counts)), FEATURE)
        .withColumn("statistic", F.greatest(F.col("area") + F.col("ref_mean"), F.lit(0.0)))
        .select(*KEY, "statistic", (F.col("statistic") / scale).alias("scaled"))
    )


def _neighbours(data: Samples, rows: DataFrame, bucketed: bool) -> DataFrame:
    """Each row with the row after it (``nxt``) and the value before it, in value order per batch.

    Inside a bucket they come from a window; the ends of buckets are linked through a small table with
    one first and one last row per bucket. Window, ends and join go by the same keys, ``_name`` for the batch since null
    joins nothing, so the rows are shuffled for them once; the ends read all columns, so that this shuffle is shared.
    """
    point = F.struct(VALUE, "ref_lt", "ref_le", "ref_mass")
    if not bucketed:
        inside = Window.partitionBy(*KEY, SALT, BUCKET).orderBy(VALUE)
        return rows.withColumns({"nxt": F.lead(point).over(inside), "prev_value": F.lag(VALUE).over(inside)})
    place = [FEATURE, SALT, BUCKET, "_name"]
    rows = rows.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col(BATCH)), F.lit("")))
    rows = rows.repartition(*place) if data.tasks is None else data.spread(rows, *place)
    inside = Window.partitionBy(*place).orderBy(VALUE)
    linked = rows.withColumns({"nxt": F.lead(point).over(inside), "prev_value": F.lag(VALUE).over(inside)})
    all_of_it = F.struct(VALUE, "ref_lt", "ref_le", "ref_mass", "cur_le", "n", "m", BATCH)
    ends = rows.groupBy(*place).agg(F.min(all_of_it).alias("_first"), F.max(VALUE).alias("_last"))
    over = Window.partitionBy(FEATURE, SALT, "_name").orderBy(BUCKET)
    after = F.lead("_first").over(over)
    links = ends.select(
        *place, F.struct(*[after[c].alias(c) for c in (VALUE, "ref_lt", "ref_le", "ref_mass")]).alias("_after"),
        after.isNotNull().alias("_has_after"), F.lag("_last").over(over).alias("_before"),
    )
    links = links.withColumn("_after", F.when(F.col("_has_after"), F.col("_after"))).drop("_has_after")
    joined = linked.join(links, place)
    return joined.withColumns({"nxt": F.coalesce("nxt", "_after"), "prev_value": F.coalesce("prev_value", "_before")})


def _whole(a: Column, b: Column) -> Column:
    """a div b for whole numbers, exact."""
    return ((a - a % b) / b).cast("bigint")


def _with_quantile(data: Samples, steps: DataFrame, k: int) -> DataFrame:
    """Add ``at``: the reference's value, and the area up to it, where its curve reaches the row's share g.

    Ranks are cut into ``k`` equal buckets. A reference value that spans several rank buckets is placed in each
    of them, so the value that holds a wanted rank is always found inside that rank's own bucket.
    """
    top = F.lit(k - 1).cast("bigint")
    n, m = F.col("n"), F.col("m")
    is_ref = F.col(BATCH).isNull()

    def bucket_of(count: Column, size: Column) -> Column:
        return F.least(_whole(count * k, F.greatest(size, F.lit(1))), top)

    own = bucket_of(F.col("cur_le"), m)
    first = F.when(is_ref, bucket_of(F.col("ref_lt"), n)).otherwise(own)
    last = F.when(is_ref, bucket_of(F.col("ref_le"), n)).otherwise(own)
    rank = F.when(is_ref, F.col("ref_le").cast("double")).otherwise(F.col("cur_le") * (n / F.greatest(m, F.lit(1))))
    mark = F.when(is_ref, F.struct(F.col(VALUE).alias("q"), F.col("a0").alias("area")))
    spread = steps.withColumns({"rank": rank, "mark": mark, "rank_bucket": F.explode(F.sequence(first, last))})
    group = [FEATURE, SALT, "rank_bucket"]
    downwards = (
        Window.partitionBy(*group)
        .orderBy(F.desc("rank"), F.col(BATCH).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return data.spread(spread, *group).withColumn("at", F.last("mark", ignorenulls=True).over(downwards))


# --- distances over cells (categories or bins) ----------------------------------------------------------


def _with_reference_cell(counts: DataFrame, salts: int, few: bool) -> DataFrame:
    """Every row with the reference's count of its own value (0 where the reference lacks it).

    ``few`` says that the reference has few cells, as bins are: they are broadcast. Else rows meet by value and salt, so
    that a value all batches have is spread over as many tasks as there are salts. The reference's rows have salt 0.
    """
    if few:
        cells = counts.where(F.col(BATCH).isNull()).select(FEATURE, VALUE, F.col("n_ref").alias("here"))
        return counts.join(F.broadcast(cells), [FEATURE, VALUE], "left").fillna({"here": 0})
    cell = Window.partitionBy(FEATURE, VALUE, SALT)
    met = dealt(counts, salts).withColumn("here", F.sum("n_ref").over(cell))
    return met.where(F.col(BATCH).isNotNull() | (F.col(SALT) == 0)).drop(SALT)


def chi_square(counts: DataFrame, unseen: float = DriftConfig.unseen_expected, salts: int = 1, few: bool = False) -> DataFrame:
    """(feature, batch, statistic, df, p_value): batch counts against the reference's shares.

    With o observed, h the reference's count and e = h m / n expected, the sum of (o - e)^2 / e over the reference's
    categories is (n / m) sum(o^2 / h) - 2 sum(o) + m, in which the categories a batch lacks have no part. So neither the
    reference's categories are listed per batch nor the batch's size is needed before its rows are summed.
    """
    rows = _with_reference_cell(counts, salts, few)
    o, h, is_known = F.col("n_cur"), F.col("here"), F.col("here") > 0
    fresh = F.pow(o - F.lit(unseen), 2) / F.lit(unseen)
    summed = rows.where(F.col(BATCH).isNotNull()).groupBy(*KEY).agg(
        F.sum("n_cur").alias("m"),
        F.coalesce(F.sum(F.when(is_known, o.cast("double") * o / h)), F.lit(0.0)).alias("squares"),
        F.coalesce(F.sum(F.when(is_known, o)), F.lit(0)).alias("met"),
        F.coalesce(F.sum(F.when(~is_known, fresh)), F.lit(0.0)).alias("fresh"),
        F.count_if(~is_known).alias("kinds"),
    )
    ref = counts.where(F.col(BATCH).isNull()).groupBy(FEATURE).agg(F.sum("n_ref").alias("n"), F.count("*").alias("ref_kinds"))
    raw = F.col("n") / F.col("m") * F.col("squares") - 2 * F.col("met") + F.col("m") + F.col("fresh")
    df = (F.col("kinds") + F.col("ref_kinds") - 1).cast("bigint")
    out = summed.join(F.broadcast(ref), FEATURE).select(  # as many rows as there are feature columns
        *KEY, F.when(df <= 0, F.lit(0.0)).otherwise(F.greatest(raw, F.lit(0.0))).alias("statistic"), df.alias("df")
    )
    return out.withColumn("p_value", chi_square_p(F.col("statistic"), F.col("df").cast("double")))


def _with_size(rows: DataFrame, parts: int) -> DataFrame:
    """Batch rows with m, the size of their batch. With ``parts`` above 1 the cells of a batch are dealt by hash, and its
    size comes from one total per part, so no task needs all cells of a batch."""
    if parts <= 1:
        return rows.withColumn("m", F.sum("n_cur").over(Window.partitionBy(*KEY)))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(VALUE), F.lit(parts)))
    totals = rows.groupBy(*KEY, "_part").agg(F.sum("n_cur").alias("_here"))
    totals = totals.select(*KEY, "_part", F.sum("_here").over(Window.partitionBy(*KEY)).alias("m"))
    return rows.join(totals, [*KEY, "_part"])


def share_distances(
    counts: DataFrame, floor: float = DriftConfig.share_floor, salts: int = 1, few: bool = False, parts: int = 1
) -> DataFrame:
    """(feature, batch, psi, jensenshannon) over bins or categories; shares are floored, natural logarithm.

    As in ``chi_square``, the cells a batch lacks come from one total per feature: what the reference alone
    would give against the floor, less the part of the cells the batch does have.
    """
    low, here = F.lit(floor), F.col("here")
    is_ref = F.col(BATCH).isNull()
    ref = counts.where(is_ref)
    sizes = ref.groupBy(FEATURE).agg(F.sum("n_ref").alias("n"))
    met = _with_reference_cell(counts, salts, few).where(~is_ref)
    rows = _with_size(met, parts).join(F.broadcast(sizes), FEATURE)  # as many rows as there are feature columns
    p, q = F.greatest(here / F.col("n"), low), F.greatest(F.col("n_cur") / F.col("m"), low)
    shares = rows.select(*KEY, (here > 0).alias("known"), p.alias("p"), q.alias("q"))
    summed = shares.groupBy(*KEY).agg(
        *[
            F.sum(term(F.col("p"), F.col("q")) - F.when(F.col("known"), term(F.col("p"), low)).otherwise(0.0)).alias(name)
            for name, term in _SHARE_TERMS.items()
        ]
    )
    own = F.greatest(F.col("n_ref") / F.col("n"), low)
    alone = ref.join(F.broadcast(sizes), FEATURE).groupBy(FEATURE).agg(
        *[F.sum(term(own, low)).alias(f"{name}_alone") for name, term in _SHARE_TERMS.items()]
    )
    return summed.join(F.broadcast(alone), FEATURE).select(
        *KEY,
        F.greatest(F.col("psi") + F.col("psi_alone"), F.lit(0.0)).alias("psi"),
        F.sqrt(F.greatest((F.col("js") + F.col("js_alone")) / 2.0, F.lit(0.0))).alias("jensenshannon"),
    )


def _psi_term(p: Column, q: Column) -> Column:
    return (p - q) * F.ln(p / q)


def _js_term(p: Column, q: Column) -> Column:
    mid = (p + q) / 2.0
    return p * F.ln(p / mid) + q * F.ln(q / mid)


_SHARE_TERMS: dict[str, Callable[[Column, Column], Column]] = {"psi": _psi_term, "js": _js_term}


# --- tests by name --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TwoSample:
    """A reference, batches named by a column, and features that share one role."""

    reference: DataFrame
    batches: DataFrame
    features: list[str]
    batch: str
    numeric: bool

    def counts(self) -> DataFrame:
        kind = "double" if self.numeric else "string"
        return value_counts(self.reference, self.batches, self.features, self.batch, kind)

    def cells(self, bins: int) -> DataFrame:
        if self.numeric:
            return bin_counts(self.reference, self.batches, self.features, self.batch, bins)
        return self.counts()

    def salts(self) -> int:
        return salt_number(self.reference, self.batches)

    def ordered(self, test: str) -> Samples:
        if not self.numeric:
            raise ValueError(f"the {test} test needs numeric features, got {self.features}")
        return samples(self.reference, self.batches, self.features, self.batch)


StatTest = Callable[[TwoSample, DriftConfig], DataFrame]
_TESTS: dict[str, StatTest] = {}


def register_stat_test(name: str, score: StatTest) -> None:
    """Add a test by name: ``score(sample, config)`` returns (feature, batch, score)."""
    _TESTS[name] = score


def run_test(name: str, sample: TwoSample, config: DriftConfig) -> DataFrame:
    if name not in _TESTS:
        raise ValueError(f"unknown drift test {name!r}; known: {sorted(_TESTS)}")
    return _TESTS[name](sample, config)


def _score(result: DataFrame, column: str) -> DataFrame:
    return result.select(*KEY, F.col(column).alias("score"))


def _chi_square_score(s: TwoSample, c: DriftConfig) -> DataFrame:
    return _score(chi_square(s.cells(c.bins), c.unseen_expected, s.salts(), s.numeric), "p_value")


def _share_score(s: TwoSample, c: DriftConfig, name: str) -> DataFrame:
    parts = 1 if s.numeric else bucket_count(s.reference, s.batches)
    return _score(share_distances(s.cells(c.bins), c.share_floor, s.salts(), s.numeric, parts), name)


register_stat_test("ks", lambda s, c: _score(ks(s.ordered("ks")), "p_value"))
register_stat_test("wasserstein", lambda s, c: _score(wasserstein(s.ordered("wasserstein")), "scaled"))
register_stat_test("chisquare", _chi_square_score)
register_stat_test("psi", lambda s, c: _share_score(s, c, "psi"))
register_stat_test("jensenshannon", lambda s, c: _share_score(s, c, "jensenshannon"))
