"""Monitoring of arriving batches: every micro-batch is compared with the reference and logged once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.config import DriftConfig
from tidegauge.operators.two_sample import BATCH
from tidegauge.plans.monitor import monitor



def logged_batches(spark: SparkSession, history: str, model: str) -> DataFrame | None:
    """The batch names of a model in the history, or None before its first row."""
    try:
        return spark.read.parquet(history).where(F.col("model") == model).select(BATCH).distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def log_batches(
    rows: DataFrame, reference: DataFrame, features: list[str], batch: str, history: str, config: DriftConfig, model: str
) -> None:
    """Append the records of the batches that the history does not hold yet; a replay adds nothing."""
    done = logged_batches(rows.sparkSession, history, model)
    fresh = rows.where(F.col(batch).isNotNull())
    if done is not None:
        fresh = fresh.join(done, fresh[batch].cast("string") == done[BATCH], "left_anti")
    records = monitor(reference, fresh, features, batch, config)
    records.withColumn("model", F.lit(model)).write.mode("append").parquet(history)


def stream_monitor(
    stream: DataFrame,
    reference: DataFrame,
    features: list[str],
    batch: str,
    history: str,
    checkpoint: str,
    config: DriftConfig = DriftConfig(),
    model: str = "model",
) -> StreamingQuery:
    """Start a query that handles what has arrived and stops.

    A batch must arrive whole in one micro-batch, as a file does. ``history`` and ``checkpoint`` are folders
    all executors share.
    """

    def handle(rows: DataFrame, _: int) -> None:
        rows.persist()
        try:
            log_batches(rows, reference, features, batch, history, config, model)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
