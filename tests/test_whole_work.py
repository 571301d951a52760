"""Queries do the work that they name, and steps that let them do it whole."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidegauge.operators import adapt as ad
from tidegauge.operators import boosting
from tidegauge.operators import training as tr
from tidegauge.plans import over_training as ot


def test_train_gbt_grows_the_configured_trees(spark, sf_dir, monkeypatch):
    met = []
    whole = tr.train_tabular

    def short(train, feature_map, algorithm, task_type, hyperparameters=None):
        met.append((algorithm, {**tr.BOOSTING, **hyperparameters}))
        return whole(train, feature_map, algorithm, task_type, {**hyperparameters, "max_iter": 2})

    monkeypatch.setattr(ot.tr, "train_tabular", short)
    got = entry.queries()["train_gbt"](spark, sf_dir).first()
    assert met == [("gradient_boosting", {"max_iter": 300, "learning_rate": 0.05, "max_depth": 7, "min_samples_leaf": 20, "l2_regularization": 0.1})]
    assert got["n_samples"] == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_all_trees_score_in_one_step(spark, monkeypatch):
    """As Spark's own trees do one by one, over columns of numbers and of categories; equal rows and batches of one row too."""
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(c), float(3 * a + (b in (1, 4)) * 9 + c * c)) for a, b, c in zip(rng.normal(size=300), rng.integers(0, 6, 300), rng.integers(-3, 4, 300))]
    kind = F.col("b").alias("b", metadata={"ml_attr": {"type": "nominal", "vals": list("uvwxyz"), "name": "b"}})
    df = spark.createDataFrame(rows + rows[:40], "a double, b double, c double, t double").select("a", kind, "c", "t")
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    fit = boosting.PenalisedBoosting(trees=12, rate=0.3, depth=5, min_rows=4, penalty=0.5, seed=1)
    model = fit.setFeaturesCol("features").setLabelCol("t").setPredictionCol("p").fit(vectors)
    assert any(tree.steps(1.0).lefts for tree in model.trees)
    table = vectors.withColumn("want", F.lit(model.base))
    for tree in model.trees:
        value = F.lit(tree.values).cast("array<double>")
        table = tree.model.transform(table).withColumn("want", F.col("want") + 0.3 * F.get(value, F.col("_leaf").cast("int"))).drop("_leaf", "_own")
    want = table.select("a", "b", "c", "want").collect()
    assert len({r["want"] for r in want}) > 50
    for cells in (10**6, 1):
        monkeypatch.setattr(boosting, "CELLS", cells)
        scored = model.transform(vectors)
        got = scored.select("a", "b", "c", "p").collect()
        assert [tuple(r)[:3] for r in got] == [tuple(r)[:3] for r in want] and [r["p"] for r in got] == pytest.approx([r["want"] for r in want], rel=1e-12)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and len(plan) < 5000
    assert model.transform(vectors.limit(0)).count() == 0
    with pytest.raises(Exception, match="non-null input argument"):
        model.transform(spark.createDataFrame([(None,)], vectors.select("features").schema)).collect()


def below(node):
    """The nodes of a plan under a node."""
    children = node.children()
    for child in (children.apply(i) for i in range(children.size())):
        yield child
        yield from below(child)


def test_every_item_meets_its_attempt_before_it_is_counted(spark, sf_dir, monkeypatch):
    """The query counts the rows of the manifest, and the manifest has a row per added item."""
    monkeypatch.setattr(ad, "ITEMS_PER_TASK", 1000, raising=False)
    out = entry.queries()["attempt_manifest"](spark, sf_dir)
    plan = out._jdf.queryExecution().optimizedPlan()
    joins = [n for n in below(plan) if n.nodeName() == "Join"]
    lowest = [j for j in joins if all(n.nodeName() != "Join" for n in below(j))]
    names = [{n.nodeName() for n in below(j)} for j in lowest]
    assert names and not any({"Aggregate", "Window"} & n for n in names)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tasks = -(-lines.count() // 1000)
    assert tasks > 1 and {n.numPartitions() for j in lowest for n in below(j) if n.nodeName() == "RepartitionByExpression"} == {tasks}
    orders = {r["o_orderkey"]: r["o_custkey"] % 97 for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()}
    rows = [(orders[r["l_orderkey"]], r["l_orderkey"], r["l_returnflag"]) for r in lines.collect() if r["l_orderkey"] in orders]
    each, whole = Counter(rows), Counter(r[:2] for r in rows)
    assert Counter(tuple(r) for r in out.collect()) == Counter((*k, n, whole[k[:2]]) for k, n in each.items())


def test_a_manifest_has_a_row_per_added_item(spark):
    items = [(1, "a", "x"), (1, "a", "x"), (1, None, None), (2, "b", "y"), (3, "a", "z"), (None, "a", "w")]
    attempts = [(7, 1), (8, 1), (8, 1), (7, 2), (None, 2), (9, 4), (7, None)]
    made = spark.createDataFrame(items, "attempt_id long, class string, path string"), spark.createDataFrame(attempts, "dataset long, attempt_id long")
    want = [(d, a, c, p) for d, a in attempts for b, c, p in items if a is not None and a == b]
    got = ad.attempt_items(*made).select("dataset", "attempt_id", "class", "path").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    each, whole = Counter(r[:3] for r in want), Counter(r[:2] for r in want)
    counted = ad.counted_attempts(*made, ["dataset"])
    assert counted.columns == ["dataset", "attempt_id", "class", "n_items", "n_items_added"]
    assert Counter(map(tuple, counted.collect())) == Counter((*k, n, whole[k[:2]]) for k, n in each.items())
    # a manifest may name no attempt
    bare = spark.createDataFrame([(None, None, "a"), (None, None, "b"), (1, None, "a")], "dataset long, attempt_id long, class string")
    assert Counter(map(tuple, ad.attempt_summary(bare, ["dataset"]).collect())) == Counter([(None, None, "a", 1, 2), (None, None, "b", 1, 2), (1, None, "a", 1, 1)])
