"""Helpers shared by the corpus operators: shared-folder checkpoints, piece counts, components, catalog."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Input bytes that one Python call works on at a time, whatever the size of the Arrow batch.
CHUNK_BYTES = 2 * 1024 * 1024
# Facts (a row per key) that are broadcast whole, and the share of all rows from which a key's fact always is.
FACT_ROWS = 50_000
HOT_SHARE = 10_000


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors reach.

    A folder of this machine is used only where the session names none and runs on this machine alone.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="tidegauge-checkpoint-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, which for a file scan is the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces_for(df: DataFrame, piece_bytes: int) -> int:
    """How many groups of about ``piece_bytes`` the input makes, and no fewer than the shuffle partitions."""
    return int(min(2**31 - 1, max(shuffle_parts(df.sparkSession), -(-input_bytes(df) // piece_bytes))))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts sum to about ``limit`` bytes; a longer text is a slice alone.

    At the end Arrow's unused memory goes back to the machine, since the worker lives on for other tasks.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype("int64"))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()


def raw(column: pa.Array) -> list:
    """The values of a string or binary column as bytes; null stays None."""
    return column.cast(pa.binary()).to_pylist() if pa.types.is_string(column.type) else column.to_pylist()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` begins with it."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def join_facts(df: DataFrame, facts: DataFrame, key: str, fact_key: str, rows: str) -> DataFrame:
    """``df`` left-joined with ``facts``, which has one row per key; null is a key like any other.

    ``facts`` is a table worth a checkpoint whose column ``rows`` says how many rows of ``df`` have the key. Up to
    ``FACT_ROWS`` facts are broadcast. Of more, those of keys with over 1 / ``HOT_SHARE`` of all rows are (at most
    ``HOT_SHARE`` by that count), and the other keys, none of them large, meet in a shuffle.
    """
    facts = checkpointed(facts)
    same = F.col(f"`{key}`").eqNullSafe(F.col(fact_key))
    n, total = facts.agg(F.count(F.lit(1)), F.sum(rows)).first()
    if n <= FACT_ROWS:
        return df.join(F.broadcast(facts), same, "left")
    hot = F.col(rows) * F.lit(HOT_SHARE) > F.lit(total)
    routed = df.join(F.broadcast(facts.where(hot)), same, "left")
    rest = routed.where(F.col(rows).isNull()).select(*[F.col(f"`{c}`") for c in df.columns])
    return routed.where(F.col(rows).isNotNull()).unionByName(rest.join(facts.where(~hot), same, "left"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of ``edges``; component is the smallest node reachable, by its value as a long.

    Alternating large and small stars: each round links every node to the least node it knows of, so the number of
    rounds grows with the logarithm of the longest chain. A hub's rows are only joined with one row for the hub, which
    AQE can split. Rows with a null end are ignored. No edges give no rows.
    """
    now = checkpointed(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )

    def mark(df: DataFrame):
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, seen = seen, mark(now)
        if before == seen:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
