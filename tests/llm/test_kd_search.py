import math

import numpy as np
from pyspark.sql import functions as F

from tidegauge.llm import kd_search
from tidegauge.llm.kd_search import Tree, top_k


def brute(rows, queries, k):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda rows: [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and good(v)]
    out = []
    for q, v in whole(queries):
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), i) for i, w in whole(rows) if i != q and len(w) == len(v)
        )[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def check(spark, rows, k=10, every=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "shard": F.lit("x")})
    got = top_k(df.repartition(3), df.where(F.col("vec_id") % every == 0), k)
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(f32, [(i, v) for i, v in f32 if i is not None and i % every == 0], k)
    assert sorted(map(tuple, got.collect())) == want


def test_ties_copies_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 40)
    monkeypatch.setattr(kd_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(kd_search, "LEAF", 4)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(200)]
    rows += [(i, [0.5, -0.25, 0.125, 0.0, 1.0]) for i in range(200, 320)]  # one vector fills a third
    rows += [(400, None), (405, [None, 1.0, 1.0, 1.0, 1.0]), (410, [math.nan, 1.0, 1.0, 1.0, 1.0]), (415, [math.inf] * 5)]
    rows += [(420, [1.0, 2.0]), (425, [2.0, 1.0]), (430, []), (None, [1.0] * 5), (435, [-3.0] * 5)]
    check(spark, rows)


def test_fewer_candidates_than_k_and_none(spark):
    check(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])])
    check(spark, [(0, [1.0])])
    check(spark, [])


def test_given_vectors(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(spark, rows, every=100)


def test_most_nodes_are_never_opened():
    """Clustered vectors: the bound lets a search end before it has seen a tenth of the leaves."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(50, 8)) * 1000
    vectors = np.repeat(centres, 400, axis=0) + rng.normal(size=(20_000, 8)) * 20
    tree, opened = Tree(vectors.astype(np.int64), np.arange(20_000), 11), 0
    whole = tree.vectors

    class Counting(np.ndarray):
        def __getitem__(self, key):
            nonlocal opened
            opened += 1
            return whole[key]

    tree.vectors = whole.view(Counting)
    found = tree.search(vectors[7].astype(np.int64).astype(float), 7, 10, -np.inf)
    scores = vectors.astype(np.int64) @ vectors[7].astype(np.int64)
    scores[7] = -(2**62)
    assert sorted((s for s, _ in found), reverse=True) == sorted(scores.tolist(), reverse=True)[:10]
    assert opened <= sum(r is not None for r in tree.rows) / 10


def test_copies_of_the_querys_own_row_hide_no_others(spark, monkeypatch):
    """Equal vectors: an id repeated more than k times takes no place from other ids."""
    monkeypatch.setattr(kd_search, "LEAF", 4)
    rng = np.random.default_rng(3)
    for k in (1, 3, 10):
        rows = [(int(i), [1.0, 2.0]) for i in rng.choice([0, 1, 2, 5, 7, 8, 9, 11], 150, p=[0.4, 0.2, 0.2, 0.1, 0.04, 0.03, 0.02, 0.01])]
        rows += [(0, [1.0, 2.0])] * 12 + [(i, [0.5, 0.5]) for i in range(20, 45)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        asked = [(i, [1.0, 2.0]) for i in (0, 1, 2, 5, 30)]
        queries = spark.createDataFrame(asked, "vec_id long, embedding array<float>")
        got = sorted(map(tuple, top_k(df.repartition(3), queries, k).collect()))
        assert got == brute(rows, asked, k)
    few = [(0, [1.0])] * 12 + [(7, [1.0]), (8, [1.0]), (9, [0.5])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    out = top_k(df, df.where("vec_id = 0").limit(1), 10).collect()
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"])] == [7, 8, 9]
