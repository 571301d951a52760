"""Drift per tumbling event-time window, as a batch plan and as a streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import no_nan, unpivot
from tidegauge.operators import two_sample as ts

START = "window_start"


def with_window(df: DataFrame, time: str, size: str) -> DataFrame:
    """Add the start of each row's tumbling window, by the time as it is stored."""
    return df.withColumn(START, F.window(time, size)["start"])


def windowed_ks(reference: DataFrame, rows: DataFrame, features: list[str], time: str, size: str) -> DataFrame:
    """(window_start, feature, statistic, p_value, n, m): exact KS of every window against the reference."""
    data = ts.samples(reference, with_window(rows, time, size), features, START)
    return ts.ks(data).withColumn(START, F.to_timestamp("batch")).drop("batch")


def reference_cells(reference: DataFrame, features: list[str], bins: int) -> DataFrame:
    """(feature, lo, hi, shares): the reference's bins, the only thing a stream needs of it.

    One row per feature column with ``bins`` numbers, so it is small whatever the reference's size.
    """
    span = reference.agg(
        *[f(no_nan(reference, c).cast("double")).alias(f"{c}_{e}") for c in features for e, f in (("lo", F.min), ("hi", F.max))]
    ).select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi")) for c in features]
            )
        )
    )
    long = unpivot(reference, [], features, "double").join(F.broadcast(span), "feature")
    counted = long.groupBy("feature", "lo", "hi").agg(
        F.count("*").alias("n"), *[F.sum((_bin(bins) == b).cast("int")).alias(f"b{b}") for b in range(bins)]
    )
    return counted.select("feature", "lo", "hi", F.array(*[F.col(f"b{b}") / F.col("n") for b in range(bins)]).alias("shares"))


def _bin(bins: int):
    place = F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    return F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)), F.lit(0))


def windowed_psi(
    cells: DataFrame, rows: DataFrame, features: list[str], time: str, size: str, late: str, bins: int = 10, floor: float = 1e-4
) -> DataFrame:
    """PSI per window and feature as one aggregate, on a batch or a streaming frame.

    The state of a window is ``bins`` counters per feature; ``late`` is the watermark delay. ``cells`` is
    the output of ``reference_cells``, a static table.
    """
    stamped = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    long = unpivot(stamped.select(time, *features), [time], features, "double")
    binned = long.join(F.broadcast(cells.select("feature", "lo", "hi")), "feature")
    counted = binned.groupBy(F.window(time, size).alias("w"), "feature").agg(
        F.count("*").alias("m"), *[F.sum((_bin(bins) == b).cast("int")).alias(f"b{b}") for b in range(bins)]
    )
    joined = counted.join(F.broadcast(cells.select("feature", "shares")), "feature")
    psi = F.lit(0.0)
    for b in range(bins):
        p = F.greatest(F.col("shares")[b], F.lit(floor))
        q = F.greatest(F.col(f"b{b}") / F.col("m"), F.lit(floor))
        psi = psi + (p - q) * F.ln(p / q)
    return joined.select(F.col("w.start").alias(START), "feature", "m", psi.alias("psi"))
