import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import rotated_clusters
from tidegauge.llm.rotated_clusters import cluster, nearest, rotated, with_inertia


def brute(rows, k, rounds, dims):
    good = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**16 for x in v)
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if good(v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(own, centres)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    sums = {n: sum(d for _, m, d in out if m == n) for _, n, _ in out}
    return sorted(((i, n, d, sums[n], sum(sums.values()), centres[n]) for i, n, d in out), key=str)


def check(spark, rows, k=4, rounds=5, dims=3):
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    df = df.withColumns({n: F.lit("x") for n in ("v", "lead", "rest", "cluster", "distance")})
    found = with_inertia(*cluster(df, k=k, rounds=rounds, dims=dims, leading=2))
    got = [
        (r["vec_id"], r["cluster"], r["distance"], int(r["cluster_inertia"]), int(r["inertia"]), r["centroid"]) for r in found.collect()
    ]
    assert sorted(got, key=str) == brute(f32, k, rounds, dims)


def test_bad_rows_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(rotated_clusters, "BATCH_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    rows += [(i, [0.25, -0.5, 0.0]) for i in range(60, 100)]  # one vector many times
    rows += [(100, None), (101, [1.0, 2.0]), (102, []), (103, [1.0, None, 2.0]), (104, [math.nan, 0.0, 0.0]), (105, [-math.inf, 0.0, 0.0])]
    rows += [(None, [0.5, 0.5, 0.5]), (3, [9.0, 9.0, 9.0]), (3, [9.0, 9.0, 9.0]), (106, [1e30, 0.0, 0.0]), (107, [-65535.0, 60000.0, 1.0])]
    check(spark, rows)


def test_equal_first_centroids_leave_one_empty(spark):
    check(spark, [(i, [1.0, 1.0, 1.0]) for i in range(6)] + [(7, [0.0, 0.0, 2.0])])


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [0.0, 0.0, 1.0]), (2, [-0.0005, 3.0, 1.0])])
    check(spark, [(1, None)])
    check(spark, [])


def test_given_vectors(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(spark, rows, k=8, rounds=10, dims=64)


@pytest.mark.parametrize("scale", [1, 1000, 10**6])
def test_bounds_rule_no_nearest_out_and_most_others(scale):
    """Vectors near a plane: of 40 centroids few are measured, and none that is nearest is missed."""
    rng = np.random.default_rng(5)
    basis = rng.normal(size=(2, 32))
    v = (scale * (rng.normal(size=(3000, 2)) * 50 @ basis + rng.normal(size=(3000, 32)))).astype(np.int64)
    centres = v[:40]
    mean = v.mean(axis=0)
    axes = np.linalg.eigh(np.cov((v - mean).T))[1][:, -4:]
    found, distance, verified = nearest(v, *rotated(v.astype(float), mean, axes), centres, *rotated(centres.astype(float), mean, axes))
    exact = ((v[:, None, :] - centres) ** 2).sum(axis=2)
    assert (found == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert verified.mean() < 8
