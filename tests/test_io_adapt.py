import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.config import DataContract, DriftConfig, FeatureConfig
from tidegauge.operators import adapt as ad
from tidegauge.operators import boosting
from tidegauge.operators import fingerprint as fp
from tidegauge.operators import metrics as mt
from tidegauge.operators import training as tr
from tidegauge.operators.features import fit_features
from tidegauge.operators.history import history_index, latest_drift
from tidegauge.plans.monitor import monitor
from tidegauge.sources import history as hist
from tidegauge.sources import metrics_sink as sink
from tidegauge.sources import tables as src
from tidegauge.streaming.monitor import stream_monitor
from tidegauge.streaming.windows import reference_cells, windowed_ks, windowed_psi


def test_csv_by_contract(spark, tmp_path):
    (tmp_path / "d.csv").write_text("label,x,n\na,1.5,3\nb,oops,4\n,2.5,\n")
    df = src.scan_dataset(spark, str(tmp_path / "d.csv"), DataContract("d", "label", {"x": "float", "n": "int", "label": "string"}))
    assert df.dtypes == [("label", "string"), ("x", "double"), ("n", "bigint")]
    assert [tuple(r) for r in df.collect()] == [("a", 1.5, 3), ("b", None, 4), (None, 2.5, None)]


def test_versioned_reference(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, y string")
    src.write_split(df, root, "iris", "v1", "train")
    src.write_split(df.limit(1), root, "iris", "v2", "train")
    src.write_split(df, root, "iris", "v1", "train")  # writing again replaces one partition
    src.write_feature_map(spark, root, "iris", "v1", {"output_features": ["x"], "target": "y"})
    rows, feature_map = src.scan_reference(spark, root, "iris", "v1")
    assert rows.count() == 2 and feature_map["output_features"] == ["x"]
    with pytest.raises(FileNotFoundError, match="feature map"):
        src.scan_reference(spark, root, "iris", "v2")
    with pytest.raises(FileNotFoundError, match="test split"):
        src.scan_reference(spark, root, "iris", "v1", "test")


def test_fit_round_trip(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "a", "y"), (3.0, "b", "n")], "x double, c string, t string")
    fitted = fit_features(train, ["x", "c"], "t", FeatureConfig("impute", scaling="standard", encoding="onehot"))
    src.write_fit(spark, fitted, str(tmp_path / "fit"))
    again = src.read_fit(spark, str(tmp_path / "fit"))
    assert again == fitted and again.transform(train).collect() == fitted.transform(train).collect()


def test_history_skips_broken_lines_and_keeps_the_rest(spark, tmp_path):
    records = spark.createDataFrame([("2024-01-01 00:00:00.123456", "tabular", "v", (True, 0.5, "medium"))], "g string, drift_type string, dataset_version_id string, overall struct<dataset_drift_detected:boolean,drift_share:double,severity:string>")
    index = history_index(records.withColumn("generated_at", F.to_timestamp("g")), F.lit("/r/1.json")).withColumn("model", F.lit("m"))
    hist.append_history(index, str(tmp_path / "h"), "model")
    hist.append_history(index, str(tmp_path / "h"), "model")
    (tmp_path / "h" / "model=m" / "part-manual.json").write_text('{"timestamp": "2024-\n{"drift_type":"image","json_path":"/x"}\n')
    entries, rejected = hist.scan_history(spark, str(tmp_path / "h"))
    assert entries.count() == 3 and rejected.count() == 1
    first = entries.where("drift_type = 'tabular'").first()
    assert first["overall_severity"] == "medium" and first["drifted_feature_count"] is None and first["timestamp"].microsecond == 123456


def test_results_scan(spark, tmp_path):
    overall = {"severity": "low", "drift_score": 0.1, "dataset_drift_detected": False}
    files = {
        "b.json": {"generated_at": "2024-01-02T00:00:00", "drift_type": "tabular", "overall": overall},
        "a.json": {"generated_at": "2024-01-03T00:00:00", "drift_type": "image", "overall": overall, "batch": {"size": 7}},
        "c_decision.json": {"overall": overall},
        "d.json": {"option": "retrain"},
    }
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "e.json").write_text("{broken")
    got = hist.scan_results(spark, str(tmp_path)).orderBy("order_key").collect()
    assert [r["source_file"] for r in got] == ["b.json", "a.json"] and got[1]["batch"]["size"] == 7


def test_latest_drift_falls_back_to_the_newest_record(spark):
    history = spark.createDataFrame([("m", 1, "/1"), ("m", 2, "/lost"), ("n", 1, "/gone")], "model string, position long, json_path string")
    records = spark.createDataFrame([("m", "/1", 5, True), ("m", "/lost", 9, False), ("m", "/new", 7, True), ("n", "/x", 1, True), ("n", "/y", 2, True), ("o", "/z", 1, False)], "model string, path string, modified_at long, readable boolean")
    got = {r["model"]: (r["path"], r["source"]) for r in latest_drift(history, records).collect()}
    assert got == {"m": ("/1", "history"), "n": ("/y", "snapshot")}


def test_json_safe_at_any_depth(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], {1: float("-inf")}, (float("nan"), "t"))], "a double, b array<double>, c map<int,double>, d struct<x:double,y:string>")
    text = json.loads(sink.json_records(df).first()["record"])
    assert text == {"a": None, "b": [1.0, None], "c": {"1": None}, "d": {"x": None, "y": "t"}}


def test_metric_rows(spark):
    df = spark.createDataFrame([("r", {"accuracy": 0.5, "lost": float("nan")})], "run string, metrics map<string,double>")
    assert [tuple(r) for r in sink.evaluation_rows(df, ["run"]).collect()] == [("r", "eval.accuracy", 0.5)]


def test_append_needs_equal_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "k long, v string"), spark.createDataFrame([(2, "y")], "k long, v string")
    assert ad.append_training_rows(a, b).count() == 2
    versions = {r["stage"]: r["version"] for r in ad.append_report(a, b).collect()}
    assert versions["before"] != versions["after"] == fp.dataset_fingerprint(a.unionByName(b)).first()["version"]
    with pytest.raises(ValueError, match="do not match"):
        ad.append_training_rows(a, b.select("v", "k"))


def test_staging_and_holdout_store(spark, tmp_path):
    data = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "k long, y string")
    drifted = spark.createDataFrame([(100 + i, "ab"[i % 2]) for i in range(20)], "k long, y string")
    staged = ad.stage_batch(data, drifted, "y", "k", 0.3)
    assert staged.holdout.count() == 6 and staged.train.count() == 14 and staged.merged.count() == 24
    with pytest.raises(ValueError, match="lacks columns"):
        ad.stage_batch(data, drifted.drop("y"), "y", "k", 0.3)
    root = str(tmp_path / "eval")
    assert ad.read_holdout(spark, root, "iris") is None
    baseline = spark.createDataFrame([("accuracy", 0.5)], "metric string, value double")
    ad.write_holdout(staged.holdout, baseline, root, "iris")
    ad.write_holdout(staged.train, baseline, root, "wine")
    holdout, metrics = ad.read_holdout(spark, root, "iris")
    assert holdout.count() == 6 and metrics.first()["value"] == 0.5 and ad.read_holdout(spark, root, "none") is None


def test_rollback_removes_exactly_the_recorded_items(spark):
    dataset = spark.createDataFrame([("a/1",), ("a/2",), ("b/3",)], "path string")
    manifest = spark.createDataFrame([("d", 1, "a", "a/1"), ("d", 2, "b", "b/3"), ("d", 2, "b", "b/gone")], "ds string, attempt_id long, class string, path string")
    latest = ad.choose_attempts(manifest, ["ds"], "latest")
    assert {r["path"] for r in ad.rolled_back(dataset, latest, ["path"]).collect()} == {"a/1", "a/2"}
    row = ad.rollback_report(dataset, latest, ["path"], ["attempt_id"]).first()
    assert (row["attempt_id"], row["removed"], row["missing"]) == (2, 1, 1)
    assert ad.choose_attempts(manifest, ["ds"], "all").count() == 3 and ad.choose_attempts(manifest, ["ds"], "1").count() == 1
    assert ad.attempt_summary(manifest, ["ds"]).where("attempt_id = 2").first()["n_items_added"] == 2


def test_names_take_the_first_free_numbers(spark):
    new = spark.createDataFrame([("c", f"in{i}/x.png") for i in range(4)] + [("c", "in/free.jpg"), ("d", "in/x.png")], "class string, path string")
    held = spark.createDataFrame([("c", "x_drifted.png"), ("c", "x_drifted_2.png"), ("c", "x_drifted_5.png"), ("c", "x.png"), ("c", "free_drifted.png")], "class string, name string")
    out = ad.safe_names(new, held)
    got = {}
    for r in out.collect():
        got.setdefault((r["class"], r["path"].split("/")[-1]), set()).add(r["new_name"])
    assert got["c", "x.png"] == {"x_drifted_1.png", "x_drifted_3.png", "x_drifted_4.png", "x_drifted_6.png"}
    assert got["c", "free.jpg"] == {"free_drifted.jpg"} and got["d", "x.png"] == {"x_drifted.png"}


@pytest.mark.parametrize("small", [10_000, 3, 1])
def test_names_of_every_route_are_alike(spark, monkeypatch, small):
    """Free, small and large groups, null classes, repeated items, names without an ending, null paths, no rows."""
    monkeypatch.setattr(ad, "SMALL_GROUP", small)
    rng = np.random.default_rng(7)
    new = [(str(rng.choice(["a", "b"])), f"in{i}/n{rng.integers(0, 12)}.png") for i in range(60)]
    new += [(None, "q/n1.png"), (None, "r/n1.png"), ("a", "in/alone"), ("a", "in/n1.png"), ("a", "in/n1.png"), ("a", None), ("b", "x/ünï.tar.gz")]
    held = [(str(rng.choice(["a", "b"])), f"n{rng.integers(0, 12)}_drifted{s}.png") for s in ["", *[f"_{k}" for k in range(1, 9)]] for _ in range(4)]
    held += [(None, "n1_drifted.png"), ("a", "n1_drifted_03.png"), ("a", None), ("a", "n2_drifted_1.jpg"), ("c", "n1_drifted.png")]
    left = spark.createDataFrame(new, "class string, path string").withColumns({"stem": F.lit("s"), "number": F.lit(1)})
    out = ad.safe_names(left, spark.createDataFrame(held, "class string, name string"))
    want, used = [], set(held)
    for c, p in sorted((x for x in new if x[1] is not None), key=lambda x: (hashlib.sha256(f"0:{x[1]}".encode()).hexdigest(), x[1])):
        name = p.split("/")[-1]
        stem, dot, ext = name.partition(".") if name.count(".") < 2 else (name[: name.rindex(".")], ".", name[name.rindex(".") + 1 :])
        k = 0
        while (c, f"{stem}_drifted{'_' + str(k) if k else ''}{dot}{ext}") in used:
            k += 1
        chosen = f"{stem}_drifted{'_' + str(k) if k else ''}{dot}{ext}"
        used.add((c, chosen))
        want.append((c, p, chosen))
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
    assert ad.safe_names(left.limit(0), spark.createDataFrame(held, "class string, name string")).count() == 0
    assert ad.safe_names(left, spark.createDataFrame([], "class string, name string")).count() == len(want)


def numbers(spark, n=400):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 2))
    return spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": np.where(x[:, 0] + 0.1 * x[:, 1] > 0, "yes", "no"), "t": 3 * x[:, 0] - x[:, 1] + 2}))


def test_training_reaches_the_floor_and_repeats(spark):
    df = numbers(spark)
    fmap = {"output_features": ["a", "b"], "target": "y"}
    for algorithm, hp in (("random_forest", {"n_estimators": 5, "max_depth": 4}), ("logistic_regression", {})):
        result = tr.train_tabular(df.select("a", "b", "y"), fmap, algorithm, "classification", hp, "v1")
        scored = result.model.transform(df).withColumn("m", F.lit("m"))
        assert mt.classification_metrics(scored, "y", "prediction", ["m"]).first()["accuracy"] > 0.9
        again = tr.train_tabular(df.select("a", "b", "y"), fmap, algorithm, "classification", hp, "v1")
        assert again.model.transform(df).select("prediction").collect() == scored.select("prediction").collect()
    record = tr.train_tabular(df.select("a", "b", "y"), fmap, "random_forest", "classification", {"n_estimators": 2, "max_depth": 2}, "v1").run_record()
    assert record["trained_at"].endswith("+00:00") and record["unused_hp.min_samples_split"] == "2" and "hp.min_samples_split" not in record
    assert record["hp.n_estimators"] == "2" and record["train_rows"] == "400" and record["dataset_version_id"] == "v1"
    assert tr.TrainingResult(None, "x", "t", {"max_depth": None}, "", 1, 1).run_record()["hp.max_depth"] == "null"
    with pytest.raises(ValueError, match="differ from the feature map"):
        tr.train_tabular(df.select("b", "a", "y"), fmap, "random_forest", "classification")
    with pytest.raises(ValueError, match="no linear_regression"):
        tr.train_tabular(df.select("a", "b", "y"), fmap, "linear_regression", "classification")


def test_boosting_penalises_leaf_values(spark, monkeypatch):
    """Against leaf sums in numpy, over a checkpoint; a larger penalty draws predictions to the mean."""
    monkeypatch.setattr(boosting, "LINEAGE", 2)
    df = numbers(spark, 120)
    table = df.toPandas()
    fmap = {"output_features": ["a", "b"], "target": "t"}
    spread = []
    for penalty in (0.0, 5.0, 1e9):
        hp = {"max_iter": 3, "max_depth": 2, "learning_rate": 0.5, "min_samples_leaf": 5, "l2_regularization": penalty}
        result = tr.train_tabular(df.select("a", "b", "t"), fmap, "gradient_boosting", "regression", hp)
        model = result.model.stages[-1]
        margin = np.full(len(table), table.t.mean())
        vectors = result.model.stages[0].transform(df)
        for tree in model.trees:
            own = tree.model.transform(vectors.select("_features", "a")).orderBy("a").toPandas()
            leaf = own["_leaf"].to_numpy().astype(int)[np.argsort(np.argsort(table.a))]
            for i in set(leaf):
                at = leaf == i
                value = (table.t - margin)[at].sum() / (at.sum() + penalty)
                assert tree.values[i] == pytest.approx(value, abs=1e-9) and at.sum() >= 5
            margin = margin + 0.5 * np.array(tree.values)[leaf]
        got = result.model.transform(df).orderBy("a").toPandas()["prediction"].to_numpy()
        assert got == pytest.approx(margin[np.argsort(table.a)])
        spread.append(float(got.std()))
        record = result.run_record()
        assert record["hp.l2_regularization"] == str(penalty) and not any(k.startswith("unused") for k in record)
    assert spread[0] > spread[1] > spread[2] and spread[2] < 1e-3
    with pytest.raises(ValueError, match="no row has a label"):
        tr.train_tabular(df.select("a", "b", "t").limit(0), fmap, "gradient_boosting", "regression", {"max_iter": 1})
    with pytest.raises(ValueError, match="must not be negative"):
        tr.train_tabular(df.select("a", "b", "t"), fmap, "gradient_boosting", "regression", {"l2_regularization": -1.0})


def test_regression_models_and_scoring(spark):
    df = numbers(spark)
    fmap = {"output_features": ["a", "b"], "target": "t"}
    linear = tr.train_tabular(df.select("a", "b", "t"), fmap, "linear_regression", "regression")
    assert list(linear.model.stages[-1].coefficients) == pytest.approx([3.0, -1.0]) and linear.model.stages[-1].intercept == pytest.approx(2.0)
    boosted = tr.train_tabular(df.select("a", "b", "t"), fmap, "gradient_boosting", "regression", {"max_iter": 10, "learning_rate": 0.3, "max_depth": 3})
    scored = boosted.model.transform(df).withColumn("m", F.lit("m"))
    assert mt.regression_metrics(scored, "t", "prediction", ["m"]).first()["r2"] > 0.8
    rows = spark.createDataFrame([(1, "1.0", "2"), (2, "x", None), (3, None, "1")], "id int, a string, b string")
    good, bad = tr.score_batch(rows, linear.model, ["a", "b"], "regression", ["id"])
    assert [(r["id"], r["prediction"], r["value"]) for r in good.collect()] == [(1, "3.0000", 3.0)]
    assert {r["id"]: r["invalid_features"] for r in bad.collect()} == {2: ["a", "b"], 3: ["a"]}
    with pytest.raises(ValueError, match="missing required"):
        tr.score_batch(rows.drop("b"), linear.model, ["a", "b"], "regression", ["id"])
    note = spark.range(1).select(tr.display_note(F.lit(2.5), 100_000, "$", "Estimated price").alias("n")).first()["n"]
    assert note == "≈ $250,000 · Estimated price (raw model output: 2.5000 × $100,000)"


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = pd.DataFrame({"x": rng.normal(size=120), "c": rng.choice(list("ab"), 120)})
    ref = spark.createDataFrame(base)
    rows = spark.createDataFrame(pd.concat([base.assign(b="one"), base.assign(x=base["x"] + 3, b="two")]))
    schema = rows.schema
    inbox, history = str(tmp_path / "in"), str(tmp_path / "history")
    rows.where("b = 'one'").coalesce(1).write.mode("append").parquet(inbox)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        stream_monitor(stream, ref, ["x", "c"], "b", history, str(tmp_path / checkpoint)).awaitTermination()

    run("ck")
    rows.where("b = 'two'").coalesce(1).write.mode("append").parquet(inbox)
    run("ck")
    run("other")  # a replay from the start
    got = {r["batch"]: r["overall"] for r in spark.read.parquet(history).collect()}
    assert spark.read.parquet(history).count() == 2
    want = {r["batch"]: r["overall"] for r in monitor(ref, rows, ["x", "c"], "b", DriftConfig()).collect()}
    assert got == want and got["two"]["drifted_feature_count"] == 1


def test_windowed_psi_streams_like_the_batch_plan(spark, tmp_path):
    rng = np.random.default_rng(2)
    stamps = pd.date_range("2024-01-01", periods=300, freq="15min")
    rows = spark.createDataFrame(pd.DataFrame({"ts": stamps, "v": rng.normal(size=300)}))
    ref = spark.createDataFrame(pd.DataFrame({"v": rng.normal(size=500)}))
    cells = reference_cells(ref, ["v"], 10)
    want = {r["window_start"]: r["psi"] for r in windowed_psi(cells, rows, ["v"], "ts", "1 day", "1 hour").collect()}
    assert len(want) == 4 and windowed_ks(ref, rows, ["v"], "ts", "1 day").count() == 4
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = windowed_psi(cells, stream, ["v"], "ts", "1 day", "1 hour")
    query = out.writeStream.outputMode("complete").format("memory").queryName("psi_windows").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r["window_start"]: r["psi"] for r in spark.table("psi_windows").collect()}
    assert got == pytest.approx(want)
