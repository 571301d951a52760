"""As-of join: for each row the latest record of its key at or before its time."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.ordered import BUCKET, bucket_edges, thinned, with_bucket

# Rows of a key that one task may order by time; a key with more is cut into spans of about so many.
SPAN_ROWS = 1_000_000


def with_span(rows: DataFrame, keys: list[str], time: Column, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Add the ordered number of each row's time span (``BUCKET``): later spans of a key have higher numbers.

    The rows per key are counted. A key with more than ``span_rows`` is cut at quantiles of its own times, so a span holds
    about as many rows as another, however the times crowd; rows of one instant stay together. Other keys are one span.
    There are at most rows / ``span_rows`` such keys. A time of null is in span 0.
    """
    at = rows.withColumn("_us", F.unix_micros(time.cast("timestamp")).cast("double"))
    large = at.where(F.col("_us").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > span_rows)
    most = large.agg(F.max("_n")).first()[0]
    if most is None:
        return at.withColumn(BUCKET, F.lit(0)).drop("_us")
    sketched = thinned(at.select(*keys, "_us")).join(F.broadcast(large.select(*keys)), keys, "left_semi")
    edges = bucket_edges(sketched, keys, "_us", -(-most // span_rows))
    return with_bucket(at, edges, keys, "_us").drop("_us")


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, span_rows: int = SPAN_ROWS
) -> DataFrame:
    """``left`` with ``match``, the newest row of ``right`` of equal keys whose time is not later (null: none).

    The rows of a busy key are cut into time spans of equal depth (``with_span``). Inside a span a window finds the
    record; the last record of each span is carried on through a small table. So a busy key, or a busy day of it, is
    ordered span by span, not all in one task. A row with a null key or time matches nothing and stays.
    """
    whole = left
    timed = reduce(and_, [F.col(k).isNotNull() for k in keys], F.col(left_time).isNotNull())
    left = whole.where(timed)
    right = right.where(reduce(and_, [F.col(k).isNotNull() for k in keys], F.col(right_time).isNotNull()))
    record = F.struct(*[F.col(c) for c in right.columns])
    row = F.struct(*[F.col(c) for c in left.columns])
    sides = left.select(*keys, F.col(left_time).alias("_at"), row.alias("_row"), F.lit(None).cast(_type(right, record)).alias("_rec"))
    sides = sides.unionByName(
        right.select(*keys, F.col(right_time).alias("_at"), F.lit(None).cast(_type(left, row)).alias("_row"), record.alias("_rec"))
    )
    sides = with_span(sides, keys, F.col("_at"), span_rows)
    is_left = F.col("_row").isNotNull().cast("int")
    so_far = Window.partitionBy(*keys, BUCKET).orderBy("_at", is_left).rowsBetween(Window.unboundedPreceding, 0)
    inside = sides.withColumn("_in", F.last("_rec", ignorenulls=True).over(so_far))
    spans = sides.groupBy(*keys, BUCKET).agg(
        F.max_by("_rec", F.when(F.col("_rec").isNotNull(), F.col("_at"))).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, BUCKET, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    joined = inside.where(F.col("_row").isNotNull()).join(carried, [*keys, BUCKET])
    found = joined.select("_row.*", F.coalesce("_in", "_carried").alias("match"))
    none = F.lit(None).cast(found.schema["match"].dataType).alias("match")
    return found.unionByName(whole.where(~timed).select(*whole.columns, none))


def _type(df: DataFrame, column):
    return df.select(column.alias("x")).schema["x"].dataType
