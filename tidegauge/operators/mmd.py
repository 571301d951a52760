"""Maximum mean discrepancy between two sets of embeddings.

The exact statistic is defined over all pairs. Rows are hashed into as many blocks as keep all tasks at work, every pair
of blocks is one tile of an even grid, and a task computes a tile's distances from Gram products and returns sums only.
So a row is sent once per block, and more rows make larger blocks until one reaches ``HELD_BYTES``. With a stored
bandwidth that is one pass over the pairs; the exact median of the distances takes two more. ``mmd_features``
replaces the pairs by random Fourier features, whose cost grows with the rows alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import checkpointed

BLOCK = 1024  # rows a side of one Gram product
LEAST_BLOCK = 128
HELD_BYTES = 32 * 1024 * 1024  # a block's vectors as doubles; a task holds two blocks
# A distance's 64 bits are read from the top in these steps, so that a pass returns at most 2**16 counts per tile. Once
# no more than ``GATHERED`` pairs share the bits read so far, the next pass reads all that is left.
BIT_STEPS = (20, 16, 14, 14)
GATHERED = 1 << 20
# Distances this small against the vectors are measured again by differences: a Gram product leaves rounding there.
NEAR = 1e-6


def _sides(reference: DataFrame, batch: DataFrame, vector: str) -> DataFrame:
    def one(df: DataFrame, is_ref: int) -> DataFrame:
        return df.where(F.col(vector).isNotNull()).select(
            F.lit(is_ref).alias("is_ref"), F.col(vector).cast(kind).alias("v")
        )

    # floats stay floats until they are multiplied, at half the bytes to send
    floats = T.ArrayType(T.FloatType())
    is_float = all(df.schema[vector].dataType.simpleString() == floats.simpleString() for df in (reference, batch))
    kind = floats.simpleString() if is_float else "array<double>"
    return one(reference, 1).unionByName(one(batch, 0))


def _distinct(rows: DataFrame) -> DataFrame:
    """Equal vectors of a side as one row with their number: copies neither fill a block nor are paired up."""
    return rows.groupBy("is_ref", "v").agg(F.count("*").alias("w"))


def _sizes(rows: DataFrame) -> tuple[int, int, int, int]:
    """Rows of the reference and of the batch, distinct vectors of both, and the components of the longest."""
    size = rows.agg(
        F.sum(F.when(F.col("is_ref") == 1, F.col("w")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("is_ref") == 0, F.col("w")).otherwise(0)).alias("m"),
        F.count("*").alias("distinct"),
        F.max(F.size("v")).alias("length"),
    ).first()
    return size["n"] or 0, size["m"] or 0, size["distinct"], size["length"] or 1


def _grid(rows: DataFrame, total: int, length: int) -> DataFrame:
    """Each row in all the tiles of its block: tile (i, j) holds blocks i and j.

    There are some four tiles per shuffle partition, fewer for few rows, and more only where a block of vectors of
    ``length`` components would exceed ``HELD_BYTES``.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    held = max(LEAST_BLOCK, HELD_BYTES // (8 * length))
    blocks = max(1, -(-total // held), min(math.isqrt(8 * parts), total // LEAST_BLOCK))
    own = F.pmod(F.xxhash64("v", "is_ref"), F.lit(blocks)).cast("int")
    many = rows.withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return many.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o")


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, by one matrix product; exactly 0 for equal rows."""
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    d2 = na[:, None] + nb[None, :]
    near = d2 * NEAR
    d2 -= 2.0 * (a @ b.T)
    rows, columns = np.nonzero(d2 < near)
    for start in range(0, len(rows), 1 << 16):
        r, c = rows[start : start + (1 << 16)], columns[start : start + (1 << 16)]
        d2[r, c] = ((a[r] - b[c]) ** 2).sum(axis=1)
    return d2


def _vectors(tile: pa.Table) -> np.ndarray:
    column = tile["v"].combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("the vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _pairs(tile: pa.Table, block: int):
    """A tile's pairs in pieces of ``block`` x ``block``: squared distances, and the rows of both sides as positions in the
    tile. Inside one block every pair counts once, so a piece on the diagonal is named and only its upper half counts."""
    own, i, j = tile["b"].to_numpy(), tile["i"][0].as_py(), tile["j"][0].as_py()
    v = _vectors(tile)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for x in range(0, len(left), block):
        a = left[x : x + block]
        for y in range(x if i == j else 0, len(right), block):
            b = right[y : y + block]
            yield _squared(v[a], v[b]), a, b, i == j and x == y


def _order_statistics(cells: DataFrame, ranks_of, block: int) -> list[float]:
    """Exact order statistics of the positive distances by counting bit prefixes from the top.

    ``ranks_of(count)`` names the wanted ranks once the first pass has the count. Every pass brings back the
    counts under the prefixes found so far, a table whose size the step width bounds.
    """
    wanted: list[tuple[int, int]] = []  # (prefix, rank below it)
    taken, inside = 0, None
    for step in BIT_STEPS:
        if taken == 64:
            break
        width = 64 - taken if inside is not None and inside <= GATHERED else step
        prefixes = sorted({p for p, _ in wanted})
        shift = 64 - taken - width

        counted = cells.groupBy("i", "j").applyInArrow(_prefix_counter(shift, width, prefixes if wanted else None, block), "prefix long, c long")
        table = counted.groupBy("prefix").agg(F.sum("c").alias("c")).orderBy("prefix").collect()
        if not wanted:
            total = sum(r["c"] for r in table)
            if total == 0:
                return []
            wanted = [(0, rank) for rank in ranks_of(total)]
            groups = {0: table}
        else:
            groups = {}
            for r in table:
                groups.setdefault(r["prefix"] >> width, []).append(r)
        found = []
        for prefix, rank in wanted:
            for r in groups[prefix]:
                if rank < r["c"]:
                    found.append((r["prefix"], rank))
                    break
                rank -= r["c"]
        wanted, taken = found, taken + width
        inside = sum(r["c"] for r in table if r["prefix"] in {p for p, _ in found})
    return [float(np.array([p], dtype=np.int64).view(np.float64)[0]) for p, _ in wanted]


def _prefix_counter(shift: int, width: int, prefixes: list[int] | None, block: int):
    """Counts of the positive distances of a cell by their leading bits, under the given shorter prefixes."""

    def counted(top: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The keys and their counts. Few bits are counted in place, many (of few distances) by sorting."""
        if width <= max(BIT_STEPS):
            low = top.min()
            tally = np.bincount(top - low, weight)
            keys = np.flatnonzero(tally)
            return keys + low, tally[keys].astype(np.int64)  # sums of whole numbers, exact to 2**53
        keys, place = np.unique(top, return_inverse=True)
        return keys, np.bincount(place, weight, len(keys)).astype(np.int64)

    def count(tile: pa.Table) -> pa.Table:
        w = tile["w"].to_numpy()
        single = bool((w == 1).all())
        keys_of, counts_of, held = [], [], 0
        for d2, a, b, diagonal in _pairs(tile, block):
            positive = d2 > 0
            if diagonal:
                positive = np.triu(positive, 1)
            top = d2[positive].view(np.int64) >> shift
            weight = None if single else (w[a][:, None] * w[b][None, :])[positive]
            for prefix in [None] if prefixes is None else prefixes:
                inside = slice(None) if prefix is None else (top >> width) == prefix
                some = top[inside]
                if not len(some):
                    continue
                keys, counts = counted(some, None if single else weight[inside])
                keys_of.append(keys)
                counts_of.append(counts)
                held += len(keys)
            if held > 1 << 21:
                keys_of, counts_of = ([x] for x in _merged(keys_of, counts_of))
                held = len(keys_of[0]) >> 1  # merge again only after as much has come
        keys, counts = _merged(keys_of, counts_of)
        return pa.table({"prefix": pa.array(keys, pa.int64()), "c": pa.array(counts, pa.int64())})

    return count


def _merged(keys_of: list[np.ndarray], counts_of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, their counts added up."""
    if not keys_of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, place = np.unique(np.concatenate(keys_of), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, np.concatenate(counts_of))
    return keys, total


def _middle(count: int) -> list[int]:
    return [count // 2] if count % 2 else [count // 2 - 1, count // 2]


def bandwidth(rows: DataFrame, distinct: int, length: int, block: int = BLOCK) -> float:
    """1 / the exact median of all positive squared distances, to be stored and used for later batches."""
    middle = _order_statistics(_grid(rows, distinct, length), _middle, block)
    return 1.0 / ((sum(middle) / len(middle) if middle else 1.0) + 1e-8)


def embedding_mmd(
    reference: DataFrame, batch: DataFrame, vector: str, block: int = BLOCK, gamma: float | None = None
) -> DataFrame:
    """(mmd, gamma, n, m): unbiased squared MMD with a Gaussian kernel, not below 0.

    ``gamma`` is a bandwidth kept from an earlier run, and the pairs are then visited once. Without one it comes from the
    exact median of all positive squared distances of both sides. Fewer than two rows on a side give 0.
    """
    rows = checkpointed(_distinct(_sides(reference, batch, vector)))
    spark = rows.sparkSession
    n, m, distinct, length = _sizes(rows)
    schema = "mmd double, gamma double, n long, m long"
    if n < 2 or m < 2:
        return spark.createDataFrame([(0.0, None, n, m)], schema)
    gamma = bandwidth(rows, distinct, length, block) if gamma is None else gamma

    def kernel(tile: pa.Table) -> pa.Table:
        ref, w = tile["is_ref"].to_numpy(), tile["w"].to_numpy()
        sides = np.stack([w * (1 - ref), w * ref]).astype(np.float64)
        sums = np.zeros((2, 2))
        for d2, a, b, diagonal in _pairs(tile, block):
            similar = np.exp(-gamma * d2)
            if diagonal:
                similar = np.triu(similar, 1)
                copies = sides[:, a] * np.maximum(w[a] - 1, 0) / 2  # pairs of equal rows
                sums += np.diag(copies.sum(axis=1))
            sums += sides[:, a] @ similar @ sides[:, b].T
        return pa.table({"yy": [sums[0, 0]], "xy": [sums[0, 1] + sums[1, 0]], "xx": [sums[1, 1]]})

    total = _grid(rows, distinct, length).groupBy("i", "j").applyInArrow(kernel, "yy double, xy double, xx double")
    sums = total.agg(F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.sum("xy").alias("xy"))
    value = (
        2.0 * F.col("xx") / float(n * (n - 1)) + 2.0 * F.col("yy") / float(m * (m - 1)) - 2.0 * F.col("xy") / float(n * m)
    )
    return sums.select(
        F.greatest(value, F.lit(0.0)).alias("mmd"), F.lit(gamma).alias("gamma"), F.lit(n).cast("bigint").alias("n"), F.lit(m).cast("bigint").alias("m")
    )


def mmd_features(
    reference: DataFrame, batch: DataFrame, vector: str, gamma: float, count: int = 512, seed: int = 42
) -> DataFrame:
    """(mmd, gamma, n, m) from random Fourier features (Rahimi and Recht, 2007): linear in the rows.

    ``gamma`` is given, e.g. from an earlier exact run. The kernel is approximated with an error of about
    1/sqrt(count); the estimate is unbiased for the features' own kernel.
    """
    rows = _sides(reference, batch, vector)
    n, m, _, _ = _sizes(rows.withColumn("w", F.lit(1)))
    spark = rows.sparkSession
    if n < 2 or m < 2:
        return spark.createDataFrame([(0.0, gamma, n, m)], "mmd double, gamma double, n long, m long")

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        seen, w = 0, None
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy())
            if w is None:
                w = np.random.default_rng(seed).normal(0.0, math.sqrt(2.0 * gamma), (x.shape[1], count))
            z = x @ w
            f = np.concatenate([np.cos(z), np.sin(z)], axis=1) / math.sqrt(count)
            for side in (0, 1):
                part = f[(pdf["is_ref"] == side).to_numpy()].sum(axis=0)
                total[side] = total.get(side, 0) + part
            seen += len(pdf)
        if seen:
            yield pd.DataFrame(
                [(side, k, float(v)) for side, vec in total.items() for k, v in enumerate(vec)], columns=["is_ref", "k", "s"]
            )

    added = rows.mapInPandas(sums, "is_ref int, k int, s double").groupBy("k").agg(
        F.sum(F.when(F.col("is_ref") == 1, F.col("s"))).alias("x"), F.sum(F.when(F.col("is_ref") == 0, F.col("s"))).alias("y")
    )
    # each feature vector has length 1, so the pairs of a row with itself add up to n and m
    xx = (F.sum(F.col("x") * F.col("x")) - n) / float(n * (n - 1))
    yy = (F.sum(F.col("y") * F.col("y")) - m) / float(m * (m - 1))
    xy = F.sum(F.col("x") * F.col("y")) / float(n * m)
    return added.agg((xx + yy - 2.0 * xy).alias("raw")).select(
        F.greatest("raw", F.lit(0.0)).alias("mmd"), F.lit(gamma).alias("gamma"), F.lit(n).cast("bigint").alias("n"), F.lit(m).cast("bigint").alias("m")
    )
