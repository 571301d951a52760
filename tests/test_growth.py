"""Work that must not grow with tasks, models or pairs beyond the rows, and queries run as they are registered."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidegauge.operators import adapt as ad
from tidegauge.operators import boosting
from tidegauge.operators import governance as gv
from tidegauge.operators import image_drift as im
from tidegauge.operators import mmd
from tidegauge.operators import training as tr
from tidegauge.operators import two_sample as ts
from tidegauge.sources import history as hist


def test_image_severity_runs_and_equals_its_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in entry.queries()["image_severity"](spark, sf_dir).select("event_id", "severity", "detected").collect())
    with duckdb.connect() as db:
        db.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
        want = sorted(db.execute(f"select event_id, severity, detected from ({entry.oracle_sql()['image_severity']})").fetchall())
    assert got == want and got


def test_a_history_has_files_by_rows_not_by_tasks_and_models(spark, tmp_path):
    names = ["_shared-3", "007", "a b/c", *[str(i) for i in range(hist.MODEL_FOLDERS + 40)]]
    rows = [(m, f"2024-01-{1 + i % 9:02d} 00:00:00", f"/r/{i}") for i, m in enumerate(names * 4 + [None])]
    index = spark.createDataFrame(rows, "model string, g string, json_path string").repartition(16)
    index = index.select(F.to_timestamp("g").alias("timestamp"), "json_path", "model")
    hist.append_history(index, str(tmp_path / "many"), "model")
    assert len(list((tmp_path / "many").rglob("*.json"))) <= 2 * hist.SHARED_FOLDERS
    shared = next(p for p in (tmp_path / "many").iterdir() if p.name.startswith(f"model={hist.SHARED}"))
    (shared / "part-manual.json").write_text('{"timestamp": "2024-\n')
    hist.append_history(index.where("model = '7'"), str(tmp_path / "many"), "model")
    entries, rejected = hist.scan_history(spark, str(tmp_path / "many"))
    want = [(r[0], r[2]) for r in rows] + [(r[0], r[2]) for r in rows if r[0] == "7"]
    got = [tuple(r) for r in entries.select("model", "json_path").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [tuple(r) for r in rejected.select("model", "value").collect()] == [(None, '{"timestamp": "2024-')]

    few = index.where("model in ('1', '2', '3')")
    hist.append_history(few, str(tmp_path / "few"), "model")
    assert len(list((tmp_path / "few").rglob("*.json"))) == 3
    assert sorted(r["model"] for r in hist.scan_history(spark, str(tmp_path / "few"))[0].collect()) == sorted([1, 2, 3] * 4)


def test_a_vector_is_sent_once_per_block_and_blocks_grow_with_the_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(0, [float(i), 1.0], 1) for i in range(50)], "is_ref int, v array<double>, w long")
    few, many = (mmd._grid(rows, total, 64).count() for total in (20_000, 400_000))
    assert few <= 8 * 50 and many <= 8 * 50
    assert mmd._grid(rows, 10**7, 64).count() > many  # a block is held by a task, so it does not grow for ever

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 3)).astype("f4"), rng.normal(0.4, 1.0, size=(50, 3)).astype("f4")
    y[:5] = x[:5]
    x[10:20] = x[9]
    sides = [spark.createDataFrame([(v.tolist(),) for v in part], "v array<float>") for part in (x, y)]
    whole = mmd.embedding_mmd(*sides, "v").first()
    monkeypatch.setattr(mmd, "LEAST_BLOCK", 8)
    monkeypatch.setattr(mmd, "HELD_BYTES", 8 * 3 * 8)
    tiles = mmd.embedding_mmd(*sides, "v", 5).first()
    d2 = ((np.concatenate([x, y])[:, None].astype("f8") - np.concatenate([x, y])[None]) ** 2).sum(-1)
    above = d2[np.triu_indices(110, 1)]
    assert whole["gamma"] == pytest.approx(1 / (np.median(above[above > 0]) + 1e-8), rel=1e-12)
    assert tiles["gamma"] == pytest.approx(whole["gamma"], rel=1e-12) and tiles["mmd"] == pytest.approx(whole["mmd"], abs=1e-12)


def test_pixels_are_bucketed_by_their_number_not_by_the_bytes_of_the_file(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i % 3, rng.normal(i % 3, 1.0, 64).round(1).tolist(), 8, 8, 1) for i in range(45)]
    images = spark.createDataFrame(rows, "label int, pixels array<double>, height int, width int, channels int")
    sides = images.where("label = 0"), images.where("label > 0")
    once = {r["batch"]: r["drift_score"] for r in im.channel_wasserstein(*sides, "label").collect()}
    monkeypatch.setattr(im, "PIXELS_PER_BUCKET", 200)
    assert im._pixel_buckets(*sides) == 15
    again = {r["batch"]: r["drift_score"] for r in im.channel_wasserstein(*sides, "label").collect()}
    assert sorted(again) == ["1", "2"] and again == pytest.approx(once, abs=1e-12)


def test_deployments_without_a_registry_run_meet_nothing(spark):
    """Rows whose registry_run_id is null reach the records without passing the join, where one task would get them all."""
    schema = """request_id long, model string, promotion_run_id string, registry_reachable boolean, registry_version long, registry_run_id string,
        outcome string, reason string, verdict string, version_id string, artifact_exists boolean, artifact_path string"""
    rows = spark.createDataFrame(
        [(i, "m", f"p{i}", True, None if i % 4 else 1, None if i % 4 else f"r{i % 8}", "approved", "x", "equal", "v1", True, "a") for i in range(40)], schema
    )
    runs = spark.createDataFrame([("r0", {"lineage.algorithm": "forest"})], "run_id string, tags map<string,string>")
    out = gv.deployment_records(rows, runs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter") :]
    assert "isnotnull(registry_run_id" in join and plan.startswith("Union")
    got = {r["request_id"]: (r["model"]["run_id"], r["model"]["algorithm"], r["readiness"]["status"]) for r in out.collect()}
    assert len(got) == 40 and out.count() == 40
    assert got[0] == ("r0", "forest", "ready") and got[4] == ("r4", None, "ready") and got[1] == ("p1", None, "no_production_model")


def test_attempts_are_counted_before_they_meet(spark, sf_dir):
    items = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (3, "a"), (None, "a")], "attempt_id long, class string")
    attempts = spark.createDataFrame([(7, 1), (8, 1), (8, 1), (7, 2), (9, 4), (7, None)], "dataset long, attempt_id long")
    got = ad.counted_attempts(items, attempts, ["dataset"])
    want = ad.attempt_summary(attempts.join(items, "attempt_id"), ["dataset"])
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() == 5
    plan = entry.queries()["attempt_manifest"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")] and "Window" not in plan[: plan.index("Join Inner")]


def test_the_counts_of_many_buckets_are_made_once(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i % 4), float(v)) for i, v in enumerate(rng.normal(size=400).round(2))]
    data = spark.createDataFrame(rows, "day int, x double").repartition(2)
    sides = data.where("day = 0"), data.where("day > 0")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = ts.wasserstein(ts.samples(*sides, ["x"], "day", 5))
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    made = [line for line in plan if re.search(r"[-+] Exchange hashpartitioning\(feature#\d+, batch#\d+, value#\d+,", line)]
    assert len(made) == 1
    once = {r["batch"]: r["statistic"] for r in ts.wasserstein(ts.samples(*sides, ["x"], "day", 1)).collect()}
    again = {r["batch"]: r["statistic"] for r in out.collect()}
    assert sorted(once) == ["1", "2", "3"] and again == pytest.approx(once, abs=1e-12)


def test_buckets_of_pixels_go_over_as_many_tasks_as_were_counted(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i % 3, rng.normal(i % 3, 1.0, 64).round(1).tolist(), 8, 8, 1) for i in range(45)]
    images = spark.createDataFrame(rows, "label int, pixels array<double>, height int, width int, channels int")
    sides = images.where("label = 0"), images.where("label > 0")
    once = {(r["batch"], r["level"]): r["drift_score"] for r in im.multiscale(*sides, "label").collect()}
    monkeypatch.setattr(im, "PIXELS_PER_BUCKET", 60)
    monkeypatch.setattr(im, "PIXELS_PER_TASK", 300)
    spread = im.multiscale(*sides, "label")
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    # 45 images of 64 pixels and a third more in the coarser levels; the windows over values and ranks, and the neighbours
    assert len(re.findall(r"RepartitionByExpression \[feature.*\], 12", plan)) >= 3
    again = {(r["batch"], r["level"]): r["drift_score"] for r in spread.collect()}
    assert len(again) == 4 and again == pytest.approx(once, abs=1e-6)


def test_boosting_merges_rows_of_equal_features(spark, monkeypatch):
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 6, 900), rng.integers(0, 4, 900)
    data = [(float(x), float(y), float(x * x - 3 * y + e)) for x, y, e in zip(a, b, rng.normal(0, 1, 900))]
    rows = spark.createDataFrame(data + [(9.0, 9.0, 500.0)] * 7, "a double, b double, t double")
    met = []

    class Counted(boosting.DecisionTreeRegressor):
        def _fit(self, dataset):
            met.append(dataset.count())
            return super()._fit(dataset)

    def fitted(df):
        hp = {"max_iter": 3, "max_depth": 3, "learning_rate": 0.5, "min_samples_leaf": 8}
        model = tr.train_tabular(df, {"output_features": ["a", "b"], "target": "t"}, "gradient_boosting", "regression", hp).model
        return [r[0] for r in model.transform(rows.select("a", "b").distinct().orderBy("a", "b")).select("prediction").collect()]

    monkeypatch.setattr(boosting, "DecisionTreeRegressor", Counted)
    merged = fitted(rows)
    assert met == [25] * 3  # 6 x 4 pairs and the one of its own
    assert merged[-1] < 400  # 7 rows are no leaf of their own
    monkeypatch.setattr(boosting, "MERGED", 10**9)
    assert fitted(rows) == pytest.approx(merged, abs=1e-9) and met[3:] == [907] * 3

    monkeypatch.setattr(boosting, "MERGED", 2)
    same = fitted(rows.selectExpr("1.0D as a", "2.0D as b", "t"))
    assert max(same) - min(same) < 1e-9
