"""Mixing sources to target weights: repetition rates from token totals, whole copies and one Bernoulli copy more."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, join_facts, shuffle_parts

WEIGHTS = (5, 2, 1)
CAP = 3
# Sources that one range partition holds while they are numbered.
SOURCES_PER_PART = 1_000_000
# Hexadecimal digits of the draw: 52 bits, which a double holds exactly.
DRAW_DIGITS = 13


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``number``: 0, 1, ... by the code points of ``source``, null last."""
    parts = -(-sources.count() // SOURCES_PER_PART) or 1
    order = F.col("source").asc_nulls_last()
    ranged = checkpointed(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("here")).select(
        "part", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return ranged.join(F.broadcast(starts), "part").withColumn("number", F.col("start") + inside - 1).drop("part", "start")


def source_targets(
    docs: DataFrame, size: Column, source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP
) -> DataFrame:
    """One row per source: source, docs, source_size, target (a double).

    Sources in order of their code points (null, a source like any other, last) take the weights in turn and share
    the sum of all sizes by them. A target stops at ``cap`` times the size of its source, and the excess is shared
    anew by weight until none is above. Each round is one sum over the sources and moves the common level up, so what
    the driver sees is two numbers a round, however many sources there are.
    """
    totals = docs.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(size).alias("source_size")
    )
    numbered = _numbered(checkpointed(totals))
    turn = F.array(*[F.lit(int(w)) for w in weights])
    known = checkpointed(
        numbered.select(
            "source",
            "docs",
            "source_size",
            F.get(turn, (F.col("number") % len(weights)).cast("int")).cast("decimal(38,0)").alias("weight"),
            (F.col("source_size").cast("decimal(38,0)") * F.lit(cap)).cast("decimal(38,0)").alias("most"),
        )
    )
    whole = known.agg(F.sum(F.col("source_size").cast("decimal(38,0)")), F.sum("weight")).first()
    total, rest, weight, full = int(whole[0] or 0), int(whole[0] or 0), int(whole[1] or 0), None
    while weight:
        level = _above(rest, weight)
        row = known.agg(
            F.sum(F.when(level, 1).otherwise(0)), F.sum(F.when(level, F.col("most"))), F.sum(F.when(~level, F.col("weight")))
        ).first()
        if row[0] == full:
            break
        full, rest, weight = row[0], total - int(row[1] or 0), int(row[2] or 0)
    level = _above(rest, weight)
    shared = _whole(rest).cast("double") * F.col("weight").cast("double") / F.lit(float(weight or 1))
    return known.select("source", "docs", "source_size", F.when(level, F.col("most").cast("double")).otherwise(shared).alias("target"))


def _whole(number: int) -> Column:
    return F.lit(Decimal(number)).cast("decimal(38,0)")


def _above(rest: int, weight: int) -> Column:
    """Whether a share of ``rest`` by weight, ``weight`` in all, is above the most a source may give; in integers."""
    if not weight:
        return F.lit(True)
    share = (F.col("weight") * _whole(rest)).cast("decimal(38,0)")
    return share > (F.col("most") * _whole(weight)).cast("decimal(38,0)")


def draw(key: Column, text: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the key alone, or on the text where there is no key."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), text), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def with_copies(
    docs: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with size (words), source_size, target (of the source) and copies: how often the mix takes the row.

    A row is taken floor(target / source_size) times and once more with the fraction as probability, so never more
    than ``cap`` times. The draw is a hash of seed and key: reruns, partitions and lost executors change nothing. Rows
    without a key draw by their text; repeated rows with one key draw alike. A source's taken words have the target as
    their expectation and a deviation of at most half the root of its summed squared sizes. Sources without words have
    target 0 and no copies. An empty table gives no rows. Columns of ``docs`` with the names of results are replaced.

    Sums are partial before they are shuffled; targets go to the rows by ``join_facts``, so neither a large source nor
    many sources gather rows in one task.
    """
    size = word_count(F.col(text))
    facts = source_targets(docs, size, source, weights, cap)
    there = fresh(docs, "mix_source")
    facts = facts.select(
        F.col("source").alias(there), F.col("docs").alias(f"{there}_rows"), F.col("source_size").alias(f"{there}_size"),
        F.col("target").alias(f"{there}_target"),
    )
    rate = F.coalesce(F.col(f"{there}_target") / F.nullif(F.col(f"{there}_size"), F.lit(0)), F.lit(0.0))
    more = draw(F.col(key), F.col(text), seed) < rate - F.floor(rate)
    found = {
        "size": size,
        "source_size": F.col(f"{there}_size"),
        "target": F.col(f"{there}_target"),
        "copies": (F.floor(rate) + more.cast("int")).cast("int"),
    }
    return join_facts(docs, facts, source, there, f"{there}_rows").select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in found], *[c.alias(n) for n, c in found.items()]
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``with_copies`` takes it, numbered by copy from 1."""
    taken = with_copies(docs, **options).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
