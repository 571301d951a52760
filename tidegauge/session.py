"""Session settings and the few size questions asked of a plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Values a job may rely on; everything about size (memory, partitions) stays with the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Input bytes per ordered bucket of a value histogram; a bigger histogram is split over more buckets per feature.
BUCKET_BYTES = 64 * 1024 * 1024
MAX_BUCKETS = 16384


def local_session(cpus: int = 8, app: str = "tidegauge", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEGAUGE_DRIVER_MEMORY", "12g"))
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegauge-"))
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df``; None where it has none."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a session without JVM access (Connect) has no estimate to give
        return None


def bucket_count(*frames: DataFrame) -> int:
    """How many ordered buckets a column's histogram needs so that no task sorts all of it."""
    total = 0
    for df in frames:
        size = plan_bytes(df)
        if size is None:
            return int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        total += size
    return max(1, min(MAX_BUCKETS, -(-total // BUCKET_BYTES)))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder every executor can reach: under the cluster's checkpoint folder, or local in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        return tempfile.mkdtemp(prefix=f"tidegauge-{name}-")
    return f"{shared.rstrip('/')}/tidegauge-{name}-{uuid.uuid4().hex}"
