import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.config import CLASSIFICATION_RULES, FeatureConfig, PromotionRule
from tidegauge.operators import features as ft
from tidegauge.operators import governance as gv
from tidegauge.operators import history as hs
from tidegauge.operators import metrics as mt
from tidegauge.operators.as_of import as_of, with_span


@pytest.fixture(scope="module")
def train(spark):
    data = [(1.0, 10.0, "b", "y"), (2.0, None, "a", "n"), (4.0, 30.0, None, "y"), (float("nan"), 30.0, "b", "n")]
    return spark.createDataFrame(data, "p double, q double, c string, target string")


def test_fit_uses_training_rows_only(spark, train):
    config = FeatureConfig("impute", scaling="standard", encoding="onehot")
    fitted = ft.fit_features(train, ["c", "q", "p"], "target", config)
    assert fitted.output_features == ["q", "p", "c_a", "c_b"]  # numeric first, then categories in order
    new = spark.createDataFrame([(100.0, 1.0, "zzz", "y"), (None, None, None, "n")], train.schema)
    out = fitted.transform(new).collect()
    p = np.array([1.0, 2.0, 4.0, 7 / 3])
    assert out[0]["p"] == pytest.approx((100 - p.mean()) / p.std()) and out[1]["p"] == pytest.approx(0.0, abs=1e-12)
    assert (out[0]["c_a"], out[0]["c_b"]) == (0.0, 0.0)  # an unknown category is zero everywhere
    assert (out[1]["c_a"], out[1]["c_b"]) == (0.0, 1.0)  # a missing one is the most frequent
    again = ft.FittedFeatures(**json.loads(json.dumps(fitted.to_dict())))
    assert again.transform(new).collect() == out


def test_constant_column_and_minmax(spark):
    df = spark.createDataFrame([(5.0, 1.0, "t"), (5.0, 3.0, "t")], "k double, v double, target string")
    standard = ft.fit_features(df, ["k", "v"], "target", FeatureConfig(scaling="standard")).transform(df).collect()
    assert [r["k"] for r in standard] == [0.0, 0.0] and [r["v"] for r in standard] == [-1.0, 1.0]
    minmax = ft.fit_features(df, ["v"], "target", FeatureConfig(scaling="minmax"))
    assert minmax.transform(spark.createDataFrame([(0.0, 7.0, "t")], df.schema)).first()["v"] == 3.0  # not clipped


def test_encoders(spark, train):
    ordinal = ft.fit_features(train, ["c"], "target", FeatureConfig(encoding="ordinal"))
    assert [r["c"] for r in ordinal.transform(train).collect()] == [1.0, 0.0, -1.0, 1.0]
    strict = ft.fit_features(train, ["c"], "target", FeatureConfig(encoding="ordinal", handle_unknown="error"))
    with pytest.raises(ValueError, match="unknown to the fit"):
        strict.transform(spark.createDataFrame([(1.0, 1.0, "new", "y")], train.schema))
    rare = ft.fit_features(train, ["c"], "target", FeatureConfig(encoding="onehot", min_frequency=2))
    assert rare.output_features == ["c_b", f"c_{ft.RARE}"]
    assert rare.transform(train).collect()[1][f"c_{ft.RARE}"] == 1.0
    with pytest.raises(ValueError, match="more than 1 categories"):
        ft.fit_features(train, ["c"], "target", FeatureConfig(encoding="onehot", max_categories=1))
    codes = {r["value"]: r["code"] for r in ft.ordinal_table(train, "c").collect()}
    assert codes == {"a": 0, "b": 1}
    names = spark.range(500).select(F.concat(F.lit("Customer#"), F.col("id") * 7 % 500).alias("c"))
    for buckets in (1, 6):  # a shared prefix does not put all names in one bucket
        wide = ft.ordinal_table(names, "c", buckets).orderBy("code").collect()
        assert [r["code"] for r in wide] == list(range(500)) and [r["value"] for r in wide] == sorted(r["value"] for r in wide)


def test_null_policies(spark, train):
    with pytest.raises(ValueError, match="p=1"):
        ft.fit_features(train, ["p", "q"], "target", FeatureConfig("fail"))
    median = ft.numeric_fills(train, ["p", "q"], "median")
    assert median == {"p": 2.0, "q": 30.0}
    assert ft.numeric_fills(train, ["p"], "constant") == {"p": 0.0}
    ties = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c string")
    assert ft.categorical_fills(ties, ["c"], "most_frequent") == {"c": "a"}


@pytest.mark.parametrize("buckets", [1, 4, 50])
def test_quantiles_equal_numpy(spark, buckets):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=200).round(2), np.full(150, 0.5)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["prob"]: r["value"] for r in ft.quantiles(df, ["v"], [0.0, 0.1, 0.5, 0.93, 1.0], buckets).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(values, p))


def test_split_stats(spark, train):
    got = {r["feature"]: r for r in ft.split_stats(train.withColumn("s", F.lit("train")), ["p", "q"], "s").collect()}
    assert (got["p"]["rows"], got["p"]["nulls"], got["p"]["max"]) == (4, 1, 4.0)
    assert got["p"]["std"] == pytest.approx(np.std([1, 2, 4], ddof=1), abs=1e-6)
    one = ft.split_stats(train.limit(1).withColumn("s", F.lit("x")), ["p"], "s").first()
    assert one["std"] is None  # one row has no sample deviation
    top = ft.top_values(train.withColumn("s", F.lit("t")), ["c"], "s", 1).collect()
    assert [(r["value"], r["n"]) for r in top] == [("b", 2)]


def test_label_index(spark, train):
    index = ft.label_index(train, "target")
    assert {r["label"]: r["class_index"] for r in index.collect()} == {"n": 0, "y": 1}
    with pytest.raises(ValueError, match="not seen"):
        ft.with_class_index(spark.createDataFrame([("q",)], "target string"), "target", index)


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "y string, p string").withColumn("m", F.lit("m"))


def test_classification_metrics(spark):
    df = scored(spark, [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "c")])
    got = mt.classification_metrics(df, "y", "p", ["m"]).first()
    assert got["accuracy"] == pytest.approx(5 / 7, abs=5e-5)
    assert got["precision"] == pytest.approx((4 * 1.0 + 3 * 2 / 3) / 7, abs=5e-5)
    assert got["recall"] == pytest.approx((4 * 0.75 + 3 * 2 / 3) / 7, abs=5e-5)
    macro = mt.classification_metrics(df, "y", "p", ["m"], "macro").first()
    assert macro["precision"] == pytest.approx((1 + 2 / 3 + 0) / 3, abs=5e-5)  # a class only predicted counts as 0
    never = mt.classification_metrics(scored(spark, [("1", "0"), ("0", "0")]), "y", "p", ["m"], "binary").first()
    assert (never["precision"], never["recall"], never["f1_score"]) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        mt.classification_metrics(df, "y", "p", ["m"], "micro")
    grid = {(r["label"], r["prediction"]): r["n"] for r in mt.confusion_matrix(df, "y", "p", ["m"]).collect()}
    assert len(grid) == 9 and grid["c", "a"] == 0 and grid["a", "a"] == 3


@pytest.mark.parametrize("block", [1024, 2])
def test_confusion_grid_in_blocks(spark, monkeypatch, block):
    """Groups of different width, a null group, nulls on either side, clashing names and no rows."""
    monkeypatch.setattr(mt, "CLASS_BLOCK", block)
    rows = [("wide", str(i), str(i * 7 % 13)) for i in range(13)] * 2 + [("narrow", "a", "b"), (None, "x", "y"), (None, "x", "x")]
    rows += [("wide", None, "3"), ("wide", "3", None), ("none", None, None)]
    df = spark.createDataFrame(rows, "m string, y string, p string").withColumns({"label": F.lit("z"), "_block": F.lit(1)})
    got = [tuple(r) for r in mt.confusion_matrix(df, "y", "p", ["m"]).select("m", "label", "prediction", "n").collect()]
    want = []
    for m in ("wide", "narrow", None):
        pairs = [(y, p) for g, y, p in rows if g == m and y is not None and p is not None]
        names = {c for pair in pairs for c in pair}
        want += [(m, a, b, pairs.count((a, b))) for a in names for b in names]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = mt.confusion_matrix(df.where("m = 'narrow'"), "y", "p", [])
    assert sorted(tuple(r) for r in whole.collect()) == [("a", "a", 0), ("a", "b", 1), ("b", "a", 0), ("b", "b", 0)]
    assert mt.confusion_matrix(df.limit(0), "y", "p", ["m"]).count() == 0 and mt.confusion_matrix(df.limit(0), "y", "p", []).count() == 0


def test_regression_metrics(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 3.0), ("m", 5.0, 4.0), ("flat", 2.0, 2.0), ("bad", 2.0, 3.0)], "m string, y double, p double")
    got = {r["m"]: r for r in mt.regression_metrics(df, "y", "p", ["m"]).collect()}
    assert (got["m"]["mae"], got["m"]["mse"], got["m"]["r2"]) == (0.6667, 0.6667, 0.75)
    assert (got["flat"]["r2"], got["bad"]["r2"]) == (1.0, 0.0)


def test_sensitivity(spark):
    names = "scenario string, accuracy double, precision double, recall double, f1_score double"
    scen = spark.createDataFrame([("x", 0.75, 0.7, 0.7, 0.7), ("y", 0.85, 0.9, 0.9, 0.9), ("z", 0.9, 0.9, 0.9, 0.9)], names)
    base = spark.createDataFrame([(0.9, 0.9, 0.9, 0.9)], names.replace("scenario string, ", ""))
    ranked = mt.sensitivity(scen, base, [])
    assert {r["scenario"]: (r["sensitivity"], r["place"]) for r in ranked.collect()} == {"x": ("high", 1), "y": ("medium", 2), "z": ("low", 3)}
    ends = mt.extremes(ranked.withColumn("m", F.lit(1)), ["m"]).first()
    assert (ends["most_sensitive"], ends["least_sensitive"], ends["scenario_count"]) == ("x", "z", 3)
    gate = spark.createDataFrame([("a", "accuracy", 0.6), ("b", "accuracy", 0.61), ("c", "r2", 0.1)], "m string, metric string, value double")
    assert {r["m"]: r["analyse"] for r in mt.analysis_gate(gate, ["m"]).collect()} == {"a": False, "b": True, "c": True}


def test_rule_operators_and_missing_metric(spark):
    rules = [PromotionRule(op, "m", 0.5, op) for op in (">=", "<=", ">", "<", "==")] + [PromotionRule("gone", "other", 1.0)]
    df = spark.createDataFrame([("eq", "m", 0.5), ("near", "m", 0.5 + 9e-7), ("hi", "m", 0.6)], "run string, metric string, value double")
    got = {(r["run"], r["rule_id"]): r["passed"] for r in gv.rule_results(df, ["run"], rules).collect()}
    assert [got["eq", o] for o in (">=", "<=", ">", "<", "==")] == [True, True, False, False, True]
    assert got["near", "=="] and not got["hi", "=="] and not got["eq", "gone"]
    lost = gv.violations(df, ["run"], rules).where("run = 'hi' and rule_id = 'gone'").first()
    assert lost["observed"] is None and "not found" in lost["description"]
    assert gv.violations(df, ["run"], CLASSIFICATION_RULES).count() == 6


def test_split_choice(spark):
    df = spark.createDataFrame([("a", "val", "accuracy", 0.9), ("a", "val", "f1_score", 0.9)], "model string, split string, metric string, value double")
    assert gv.violations_by_split(df, ["model"], CLASSIFICATION_RULES, "val").count() == 0
    both = gv.violations_by_split(df, ["model"], CLASSIFICATION_RULES, "both").collect()
    assert [(r["split"], r["rule_id"]) for r in both] == [("test", "missing_split")]
    with pytest.raises(ValueError):
        gv.violations_by_split(df, ["model"], CLASSIFICATION_RULES, "train")


def test_compare_and_verdict(spark):
    shape = "model string, metric string, value double"
    cand = spark.createDataFrame([("a", "accuracy", 0.8), ("a", "mae", 0.3), ("b", "accuracy", 0.8 + 5e-7), ("c", "accuracy", 0.9), ("d", "accuracy", 0.9), ("d", "mae", 0.9), ("e", "mae", 1.0)], shape)
    prod = spark.createDataFrame([("a", "accuracy", 0.7), ("a", "mae", 0.4), ("b", "accuracy", 0.8), ("d", "accuracy", 0.8), ("d", "mae", 0.8), ("e", "accuracy", 1.0)], shape)
    cmp = gv.compare_models(cand, prod, ["model"], ["accuracy", "mae"])
    got = {r["model"]: (r["overall_verdict"], r["is_better"]) for r in gv.overall_verdict(cmp, cand, prod, ["model"]).collect()}
    assert got == {"a": ("better", True), "b": ("equal", False), "c": ("no_baseline", None), "d": ("mixed", False), "e": ("equal", False)}


def test_registry(spark):
    versions = spark.createDataFrame([("m", 2, "r2", "Production"), ("m", 10, "r10", "Production"), ("m", 11, "r11", "Staging"), ("k", 1, "r1", "Staging")], "model string, version long, run_id string, stage string")
    top = gv.current_production(versions).collect()
    assert [(r["model"], r["version"], r["candidates"]) for r in top] == [("m", 10, 2)]
    ask = spark.createDataFrame([("m", "r2", 1), ("m", "new2", 9), ("m", "new1", 5), ("z", "first", 1)], "model string, run_id string, requested_at long").withColumn("requested_at", F.timestamp_seconds("requested_at"))
    got = {(r["model"], r["run_id"]): (r["version"], r["is_new"]) for r in gv.register_versions(ask, versions).collect()}
    assert got == {("m", "r2"): (2, False), ("m", "new1"): (12, True), ("m", "new2"): (13, True), ("z", "first"): (1, True)}


def test_report_age(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-07 23:00:00",), ("2024-01-08T02:00:00+02:00",), ("soon",)], "g string")
    now = F.lit("2024-01-08T00:00:00Z").cast("timestamp")
    got = df.select(*[c.alias(n) for n, c in gv.report_age(F.col("g"), now).items()]).collect()
    assert [(r["age_days"], r["age_hours"], r["is_stale"]) for r in got] == [(7, 168.0, True), (0, 1.0, False), (0, 0.0, False), (None, None, None)]


def test_as_of_carries_over_spans(spark):
    left = spark.createDataFrame([("a", "2024-01-05 10:00:00", 1), ("a", "2024-01-01 00:00:00", 2), ("b", "2024-01-05 00:00:00", 3), ("a", "2024-01-02 08:00:00", 4)], "k string, t string, id int").withColumn("t", F.to_timestamp("t"))
    right = spark.createDataFrame([("a", "2024-01-02 08:00:00", "x"), ("a", "2024-01-05 11:00:00", "late")], "k string, at string, v string").withColumn("at", F.to_timestamp("at"))
    got = {r["id"]: r["match"]["v"] if r["match"] else None for r in as_of(left, right, ["k"], "t", "at").collect()}
    assert got == {1: "x", 2: None, 3: None, 4: "x"}


@pytest.mark.parametrize("span_rows", [7, 100])
def test_as_of_and_versions_of_a_key_that_crowds_one_day(spark, span_rows):
    """Half of all rows belong to one model and one second of a day: cut into spans of about the wished depth."""
    rng = np.random.default_rng(9)
    at = np.where(rng.random(400) < 0.5, 1000 + rng.integers(0, 1000, 400) / 1000, rng.integers(0, 900_000, 400))
    left = pd.DataFrame({"k": rng.choice(["hot", "hot", "hot", "b", "c"], 400), "id": range(400), "t": at.round(3)})
    right = pd.DataFrame({"k": rng.choice(["hot", "b"], 300), "v": range(300), "at": (rng.choice(at, 300) + rng.integers(0, 3, 300)).round(3)})
    right = right.drop_duplicates(["k", "at"])
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("at"), left_on="t", right_on="at", by="k")
    sides = [spark.createDataFrame(d).withColumn(c, F.timestamp_millis((F.col(c) * 1000).cast("long"))) for d, c in ((left, "t"), (right, "at"))]
    got = {r["id"]: r["match"] and r["match"]["v"] for r in as_of(*sides, ["k"], "t", "at", span_rows).collect()}
    assert got == {int(i): None if pd.isna(v) else int(v) for i, v in zip(want["id"], want["v"])}
    spans = with_span(sides[0], ["k"], F.col("t"), span_rows).groupBy("k", "_bucket").count().collect()
    hot = [r["count"] for r in spans if r["k"] == "hot"]
    assert len(hot) > 240 / span_rows / 2 and max(hot) < 4 * span_rows
    asks = sides[0].select(F.col("k").alias("model"), F.format_string("r%03d", "id").alias("run_id"), F.col("t").alias("requested_at"))
    none = spark.createDataFrame([], "model string, version long, run_id string")
    numbered = {r["run_id"]: r["version"] for r in gv.register_versions(asks, none, span_rows).collect()}
    order = left.sort_values(["k", "t", "id"])
    assert numbered == {f"r{i:03d}": n for i, n in zip(order["id"], order.groupby("k").cumcount() + 1)}


def test_trends(spark):
    def trend(*severities):
        data = [("m", i, s) for i, s in enumerate(severities)]
        df = spark.createDataFrame(data, "m string, at long, severity string").withColumn("tie", F.col("at"))
        return hs.severity_trend(df, ["m"], "at", "tie").first()["trend"]

    assert trend("low") == hs.TOO_FEW
    assert trend("low", "high") == hs.WORSENING and trend("high", "low") == hs.IMPROVING
    assert trend("high", "low", "low", "medium", "low", "low") == hs.STABLE  # only the last five count
    counts = spark.createDataFrame([("m", True, "high"), ("m", None, "odd"), ("m", False, "medium")], "m string, detected boolean, severity string")
    row = hs.summary_counts(counts, ["m"]).first()
    assert (row["runs"], row["drifted"], row["percent"], row["high"], row["medium"], row["low"]) == (3, 1, 33, 1, 1, 1)
