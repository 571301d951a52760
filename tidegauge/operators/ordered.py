"""Exact running sums over a sorted column without one task sorting the whole column.

A value histogram (one row per distinct value) is cut into ordered buckets. Each bucket is summed in
parallel, the bucket totals (a small table) give every bucket its starting point, and a window adds up
inside the bucket. With one bucket this is a plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import plan_bytes

BUCKET = "_bucket"
CHUNK = 64
CLASSES = 4
THIN_BYTES = 2 * 1024 * 1024


def thinned(df: DataFrame) -> DataFrame:
    """Some rows of ``df``, enough to place cut points. No result is computed from them."""
    size = plan_bytes(df)
    if size is None or size <= THIN_BYTES:
        return df
    return df.sample(fraction=max(THIN_BYTES / size, 1e-6), seed=17)


def bucket_edges(rows: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame | None:
    """At most ``buckets - 1`` cut points per key, from quantile sketches of ``rows`` (a thinned table).

    The cut points are brought to the driver (keys x buckets numbers) so that every branch of the plan
    that follows uses the very same ones. They only balance the work; any cut points give the same sums.
    Values are sketched in four classes by hash: a value that fills most rows can bend one class only.
    """
    if buckets <= 1:
        return None
    per_class = max(1, -(-buckets // CLASSES))
    probs = [i / (per_class + 1) for i in range(1, per_class + 1)]
    own = F.pmod(F.xxhash64(F.col(value)), F.lit(CLASSES))
    sketch = rows.groupBy(*keys).agg(
        F.concat(
            *[
                F.coalesce(
                    F.percentile_approx(F.when(own == c, F.col(value)), probs, min(50 * per_class, 200_000)),
                    F.array().cast("array<double>"),
                )
                for c in range(CLASSES)
            ]
        ).alias("edges")
    )
    found = []
    for row in sketch.collect():
        edges = sorted({float(e) for e in row["edges"] or []})
        chunks = [edges[i : i + CHUNK] for i in range(0, len(edges), CHUNK)]
        found.append((*[row[k] for k in keys], [c[-1] for c in chunks], chunks))
    key_fields = [sketch.schema[k] for k in keys]
    schema = T.StructType(
        key_fields
        + [
            T.StructField("_tops", T.ArrayType(T.DoubleType())),
            T.StructField("_chunks", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )
    return rows.sparkSession.createDataFrame(found, schema)


def text_edges(values: DataFrame, column: str, buckets: int) -> list[str]:
    """Cut points for distinct texts: the ones with the smallest hashes are an even sample of them."""
    if buckets <= 1:
        return []
    picked = values.orderBy(F.xxhash64(column)).limit(16 * buckets).collect()
    ordered = sorted(r[column] for r in picked)
    return sorted({ordered[i] for i in range(16, len(ordered), 16)})


def in_text_buckets(values: DataFrame, column: str, edges: list[str]) -> DataFrame:
    """Add the ordered bucket number of a text: how many cut points are not above it."""
    if not edges:
        return values.withColumn(BUCKET, F.lit(0))
    tops = F.array(*[F.lit(e) for e in edges])
    return values.withColumn(BUCKET, F.size(F.filter(tops, lambda e: e <= F.col(column))))


def with_bucket(df: DataFrame, edges: DataFrame | None, keys: list[str], value: str) -> DataFrame:
    """Add the ordered bucket number of ``value``: how many cut points lie below it.

    Two short searches (which chunk, then where in it) instead of one over all cut points.
    """
    if edges is None:
        return df.withColumn(BUCKET, F.lit(0))
    v = F.col(value).cast("double")
    full = F.coalesce(F.size(F.filter("_tops", lambda e: e < v)), F.lit(0))
    rest = F.coalesce(F.size(F.filter(F.get("_chunks", full), lambda e: e < v)), F.lit(0))
    return (
        df.join(F.broadcast(edges), keys, "left")
        .withColumn(BUCKET, full * CHUNK + F.greatest(rest, F.lit(0)))
        .drop("_tops", "_chunks")
    )


def _offsets(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, BUCKET).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    return totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sums: dict[str, Column],
    bucketed: bool,
    base: DataFrame | None = None,
    latest: dict[str, str] | None = None,
) -> DataFrame:
    """Add one inclusive running sum per entry of ``sums``, per key and row by row in the given order.

    ``df`` carries the bucket column; rows of a lower bucket come before rows of a higher one. ``base`` is a
    simpler table with the same rows, from which the bucket totals are taken. ``latest`` adds the last
    non-null value so far of a column, inside its bucket, by the same window.
    """
    window = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = {n: F.sum(c).over(window) for n, c in sums.items()}
    seen = {n: F.last(c, ignorenulls=True).over(window) for n, c in (latest or {}).items()}
    if not bucketed:
        return df.withColumns({**inside, **seen})
    offsets = _offsets(df if base is None else base, keys, sums)
    null_safe = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys + [BUCKET]]
    joined = df.alias("l").join(offsets.alias("r"), null_safe, "left").select(
        "l.*", *[F.col(f"r._o_{n}") for n in sums]
    )
    added = {n: c + F.col(f"_o_{n}") for n, c in inside.items()}
    return joined.withColumns({**added, **seen}).drop(*[f"_o_{n}" for n in sums])
