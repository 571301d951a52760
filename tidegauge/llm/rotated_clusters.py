"""Exact k-means over integer vectors, its centroids filtered by bounds in a PCA-rotated space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SCALE = 1024
# Scaled components reach 2^26 at most: a squared distance over 64 of them then fits a long with room to spare.
MOST = 2**26
LEADING = 16
# Relative slack of the floating bounds, far above their rounding error, so that no nearest centroid is ruled out.
SLACK = 1e-9
BATCH_ROWS = 16_384


def whole_vectors(df: DataFrame, vector: str = "embedding", dims: int = 64) -> DataFrame:
    """(vec_id, v): the vectors with exactly ``dims`` components, each floor(1024 * x).

    Left out are vectors that are null or hold a null or non-finite component, or one of 2^16 and more by its size:
    squared distances between such would not fit a long.
    """
    fits = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float(MOST // SCALE))))
    return df.where((F.size(vector) == dims) & fits).select(
        "vec_id", F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("int")).alias("v")
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def rotation(vectors: DataFrame, dims: int, leading: int = LEADING) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the mean of all vectors and the ``leading`` principal axes, as columns.

    Every task sends dims * (dims + 1) + 1 sums of products; they are added up before the driver sees them.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((dims + 1, dims + 1))
        for batch in _slices(batches):
            x = _matrix(batch.column("v"), dims).astype(np.float64)
            x = np.hstack([x, np.ones((len(x), 1))])
            sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["at", "value"])

    found = vectors.select("v").mapInArrow(products, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    sums = np.zeros((dims + 1) ** 2)
    for row in found.collect():  # (dims + 1)^2 numbers
        sums[row["at"]] = row["value"]
    sums = sums.reshape(dims + 1, dims + 1)
    n = max(sums[dims, dims], 1.0)
    mean = sums[dims, :dims] / n
    spread, axes = np.linalg.eigh(sums[:dims, :dims] / n - np.outer(mean, mean))
    return mean, axes[:, np.argsort(-spread)[: min(leading, dims)]]


def rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates, and the norm of what they leave out."""
    moved = x - mean
    lead = moved @ axes
    rest = np.einsum("ij,ij->i", moved, moved) - np.einsum("ij,ij->i", lead, lead)
    return lead, np.sqrt(np.maximum(rest, 0.0))


def with_rotation(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``vectors`` (vec_id, v) with lead and rest, as every round reads them."""
    dims = len(mean)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            lead, rest = rotated(_matrix(batch.column("v"), dims).astype(np.float64), mean, axes)
            ends = pa.array(np.arange(0, lead.size + 1, lead.shape[1], dtype=np.int32))
            leads = pa.ListArray.from_arrays(ends, pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), leads, pa.array(rest)], ["vec_id", "v", "lead", "rest"]
            )

    return vectors.mapInArrow(turn, "vec_id long, v array<int>, lead array<double>, rest double")


def nearest(
    v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, distance, verified) of each vector: exact, ties to the smaller number.

    The squared distance of the leading coordinates plus the squared difference of the residual norms is at most the
    squared distance. The centroid with the least bound is measured in integers first; of the others only those whose
    bound does not exceed that distance are. ``verified`` counts the measured ones.
    """
    own, theirs = np.einsum("ij,ij->i", lead, lead), np.einsum("ij,ij->i", c_lead, c_lead)
    bound = own[:, None] - 2.0 * (lead @ c_lead.T) + theirs + (rest[:, None] - c_rest) ** 2
    bound -= SLACK * (own[:, None] + theirs + rest[:, None] ** 2 + c_rest**2 + 1.0)
    wide = v.astype(np.int64)

    def measure(rows, numbers):
        away = wide[rows] - centroids[numbers]
        return np.einsum("ij,ij->i", away, away)

    cluster = bound.argmin(axis=1)
    distance = measure(slice(None), cluster)
    verified = np.ones(len(v), dtype=np.int32)
    left = bound <= distance[:, None] * (1.0 + SLACK)
    left[np.arange(len(v)), cluster] = False
    for number in range(len(centroids)):
        rows = np.flatnonzero(left[:, number])
        if len(rows):
            other = measure(rows, np.full(len(rows), number))
            verified[rows] += 1
            better = (other < distance[rows]) | ((other == distance[rows]) & (number < cluster[rows]))
            cluster[rows[better]], distance[rows[better]] = number, other[better]
    return cluster, distance, verified


def _assignments(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray):
    """Each slice of ``batches`` with its nearest centroids."""
    dims, width = len(mean), axes.shape[1]
    c_lead, c_rest = rotated(centroids.astype(np.float64), mean, axes)
    for batch in _slices(batches):
        v = _matrix(batch.column("v"), dims)
        lead, rest = _matrix(batch.column("lead"), width), batch.column("rest").to_numpy()
        yield batch, v, *nearest(v, lead, rest, centroids, c_lead, c_rest)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the least sha256 of ``seed:vec_id``; equal ids by their components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return np.array([r["v"] for r in rows], dtype=np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of their vectors; those without a vector stay.

    A task sends one row per centroid and component; the driver receives that many in all.
    """
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=np.int64)
        for _, v, cluster, _, _ in _assignments(batches, centroids, mean, axes):
            for number in np.unique(cluster):
                mine = v[cluster == number]
                total[number, :dims] += mine.sum(axis=0, dtype=np.int64)
                total[number, dims] += len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    found = vectors.mapInArrow(sums, "at long, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total = [[0] * (dims + 1) for _ in range(k)]
    for row in found.collect():  # k * (dims + 1) numbers
        total[row["at"] // (dims + 1)][row["at"] % (dims + 1)] = int(row["value"])
    return np.array(
        [[s // t[dims] for s in t[:dims]] if t[dims] else c for t, c in zip(total, centroids.tolist())], dtype=np.int64
    )


def cluster(
    df: DataFrame, vector: str = "embedding", k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, leading: int = LEADING
) -> tuple[DataFrame, np.ndarray]:
    """(assigned, centroids): vec_id, cluster, distance (squared) and verified of every whole vector, and the centroids.

    The rotated vectors are written once to the shared folder and read by every round. Nothing depends on how rows are
    dealt, nor on the rotation: it only says which centroids need no exact measuring. ``vec_id`` may be null or repeat;
    every row is a vector of its own. Fewer than k vectors give as many centroids as there are vectors, equal ones
    leave the later number empty, and without vectors there are no rows. Other columns are ignored.
    """
    vectors = whole_vectors(df, vector, dims)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0 AS verified").where("false"), centroids
    mean, axes = rotation(vectors, dims, leading)
    ready = checkpointed(with_rotation(vectors, mean, axes))
    for _ in range(rounds):
        after = moved(ready, centroids, mean, axes)
        if np.array_equal(after, centroids):
            break  # every further round would be the same
        centroids = after

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, number, distance, verified in _assignments(batches, centroids, mean, axes):
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance), pa.array(verified)],
                ["vec_id", "cluster", "distance", "verified"],
            )

    return checkpointed(ready.mapInArrow(last, "vec_id long, cluster int, distance long, verified int")), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the summed distances of its cluster and of all, and the final centroid; k rows are broadcast."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    own = {r["cluster"]: r["sum"] for r in sums}
    facts = [(n, own.get(n), sum(own.values()), [int(x) for x in c]) for n, c in enumerate(centroids)]
    schema = "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>"
    return assigned.join(F.broadcast(assigned.sparkSession.createDataFrame(facts, schema)), "cluster")
