"""Boilerplate lines: those on too large a share of the pages of their own site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

RATIO = 0.1
MIN_PAGES = 5
# Sites and boilerplate lines that may be broadcast (about 50 bytes each), and over how many tasks a site's pages are
# dealt when there are more.
BROADCAST_MARKS = 200_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _mark(line: Column) -> Column:
    """Two independent hashes of the trimmed line: 96 bits, so that lines need not travel."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("x"), F.hash(F.lit("line"), line).alias("m"))


def boilerplate(df: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): per site the marks of the lines on more than ``ratio`` of its pages and on ``min_pages`` at least.

    A page counts a line once. With L lines on a mean page, a site has at most L / ratio such lines, however large it
    is. Counting is partial before the shuffle, so a site with a third of all pages is no larger a group than another.
    """
    pages = df.select(F.col(host).alias("host"), F.col(text).alias("body")).where("host is not null")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = pages.select("host", F.explode(F.array_distinct(F.transform(_lines(F.col("body")), lambda x: F.trim(x)))).alias("line"))
    counts = (
        seen.where("line != ''").groupBy("host", _mark(F.col("line")).alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        counts.where(F.col("n") >= min_pages)
        .join(totals, "host")
        .where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("mark").alias("lines"))
    )


def drop_site_lines(
    df: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    dropped: str | None = None,
) -> DataFrame:
    """``df`` with the boilerplate lines of its site taken out of ``text``; all columns and rows stay.

    ``dropped`` names a column to add: how many lines were taken out, null for a null text.

    Lines end at a newline and are compared without blanks at their ends; blank lines are never boilerplate. A null
    text stays null, a text whose every line goes becomes empty, and a row without a host is left as it is, since it
    belongs to no site. Repeated rows count as pages each. An empty table gives no rows. Names that the work needs are
    made so that they clash with no column of ``df``.
    """
    lines = _fresh(df, "boilerplate_lines")
    site = _fresh(df, "boilerplate_host")
    found = checkpointed(boilerplate(df, host, text, ratio, min_pages)).select(
        F.col("host").alias(site), F.col("lines").alias(lines)
    )
    size = found.agg(F.count(F.lit(1)), F.sum(F.size(lines))).first()
    if size[0] + (size[1] or 0) <= BROADCAST_MARKS:
        joined = df.join(F.broadcast(found), F.col(host) == F.col(site), "left")
    else:  # a site's pages are dealt over several tasks, each with the site's lines
        salt, part = _fresh(df, "boilerplate_salt"), _fresh(df, "boilerplate_part")
        dealt = found.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = df.withColumn(salt, F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, (F.col(host) == F.col(site)) & (F.col(salt) == F.col(part)), "left")
    kept = F.filter(_lines(F.col(text)), lambda line: ~F.array_contains(F.col(lines), _mark(line)))
    clean = F.when(F.col(lines).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    columns = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    if dropped is not None:
        lost = F.size(_lines(F.col(text))) - F.size(kept)
        zero = F.when(F.col(text).isNotNull(), 0)
        columns.append(F.when(F.col(lines).isNull(), zero).otherwise(lost).cast("long").alias(dropped))
    return joined.select(*columns)


def _fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
