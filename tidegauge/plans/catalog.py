"""The named queries: one Spark function per operator over the test tables, and the same in ANSI SQL.

Module ``plans.over_*`` register themselves here; ``__spark_entry__`` hands the two maps to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """An input table written in SQL that both engines read alike, over the given tables."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if t in sql}
    for name, df in used.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def r6(c: Column | str, digits: int = 6) -> Column:
    """Six digits, and no negative zero, for comparison across engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)
