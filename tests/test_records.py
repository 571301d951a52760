import pytest

from tidegauge.operators import governance as gv

RUNS = "run_id string, task_type string, dataset string, tags map<string,string>, params map<string,string>"
FULL = {"pipeline.execution_id": "e1", "pipeline.config_hash": "c0", "pipeline.dataset_version_id": "v1"}
TRAINED = {"algorithm": "random_forest", "train_rows": "10", "trained_at": "2024-01-01T00:00:00+00:00"}


def test_lineage_is_built_and_checked(spark):
    runs = [
        ("whole", "classification", "iris", FULL, TRAINED),
        ("numbers", "regression", "iris", FULL, TRAINED),
        ("bare", "classification", "iris", None, None),
        ("other", "clustering", "iris", FULL, TRAINED),
        ("undecided", "regression", None, FULL, {**TRAINED, "trained_at": None}),
    ]
    metrics = [("whole", "accuracy", 0.12345678), ("whole", "f1_score", 1.0), ("whole", "mae", 3.0), ("whole", "recall", None)]
    metrics += [("numbers", "mse", 123456789.125), ("numbers", "mae", 0.0000123), ("numbers", "rmse", 0.0005), ("numbers", "r2", float("-inf"))]
    metrics += [("other", "accuracy", 1.0), ("undecided", "r2", float("nan")), (None, "r2", 0.5)]
    decisions = [("whole", "approved", "improvement"), ("whole", "approved", "equal"), ("numbers", "rejected", None), ("bare", "approved", "x"), ("other", "approved", "x")]
    out = gv.lineage_tags(
        spark.createDataFrame(runs, RUNS),
        spark.createDataFrame(metrics, "run_id string, metric string, value double"),
        spark.createDataFrame(decisions, "run_id string, outcome string, verdict string"),
    )
    got = {r["run_id"]: r for r in out.collect()}
    assert len(got) == 5 and [got[k]["complete"] for k in ("whole", "numbers", "bare", "other", "undecided")] == [True, True, False, False, False]
    kept = got["whole"]["kept_tags"]
    assert (kept["lineage.eval.accuracy"], kept["lineage.eval.f1_score"], kept["lineage.comparison_verdict"]) == ("0.123457", "1.0", "improvement")
    assert "lineage.eval.mae" not in kept and "lineage.eval.recall" not in kept and kept["lineage.decision_artifact"] == "promotion/promotion_decision.json"
    numbers = got["numbers"]["kept_tags"]
    assert [numbers[f"lineage.eval.{m}"] for m in ("mse", "mae", "rmse", "r2")] == ["123456789.125", "1.2e-05", "0.0005", "-inf"]
    assert "lineage.comparison_verdict" not in numbers
    assert got["bare"]["missing"] == ["lineage.algorithm", "lineage.config_hash", "lineage.dataset_version_id", "lineage.trained_at"]
    assert not got["other"]["supported"] and "lineage.eval.accuracy" not in got["other"]["kept_tags"]
    assert got["undecided"]["missing"] == ["lineage.promotion_outcome", "lineage.trained_at"] and got["undecided"]["kept_tags"]["lineage.eval.r2"] == "nan"
    empty = gv.lineage_tags(spark.createDataFrame([], RUNS), spark.createDataFrame([], "run_id string, metric string, value double"), spark.createDataFrame([], "run_id string, outcome string, verdict string"))
    assert empty.count() == 0


@pytest.mark.parametrize("span", [1, 1000])
def test_answers_to_drift(spark, span):
    answers = [(1, "m", "2024-01-05", "Retrain ", " late "), (2, "m", "2023-01-01", "accept", "early"), (3, "m", "2024-01-05", "cancelled", None)]
    answers += [(4, "m", "2024-01-05", "retrain", " "), (5, "m", "2024-01-05", None, "x"), (6, None, "2024-01-05", "accept", "x"), (7, "n", None, "nothing", "x")]
    reports = [("m", "2024-01-01", "tabular", "low", "a.json"), ("m", "2024-01-04", "image_embedding", "high", "b.json"), ("m", "2024-01-06", "tabular", "low", "c.json"), (None, "2024-01-01", "tabular", "low", "z.json")]
    left = spark.createDataFrame(answers, "decision_id long, model string, decided_at string, option string, reason string").selectExpr("* except (decided_at)", "cast(decided_at as timestamp) as decided_at", "'clash' as severity")
    right = spark.createDataFrame(reports, "model string, generated_at string, drift_type string, severity string, report string").selectExpr("* except (generated_at)", "cast(generated_at as timestamp) as generated_at")
    got = {r["decision_id"]: r for r in gv.drift_responses(left, right, span).collect()}
    assert len(got) == 7
    first = got[1]
    assert (first["option"], first["reason"], first["drift_type"], first["drift_severity"], first["drift_report_linked"], first["problem"]) == ("retrain", "late", "image_embedding", "high", "b.json", None)
    assert got[2]["drift_type"] is None and got[2]["drift_report_linked"] == "drift_result.json" and got[2]["problem"] is None
    assert [got[i]["problem"] for i in (3, 4, 5, 7)] == [None, "reason_missing", "unknown_option", "unknown_option"] and got[3]["reason"] == ""


def test_deployment_records(spark):
    schema = "request_id long, model string, registry_reachable boolean, registry_version int, registry_run_id string, promotion_run_id string, outcome string, reason string, verdict string, version_id string, artifact_exists boolean, artifact_path string"
    rows = [
        (1, "m", True, 3, "r3", "p1", "approved", "good", "improvement", "v9", True, "a/b"),
        (2, "m", True, None, None, "p2", "approved", None, None, "v9", False, "a/c"),
        (3, "m", True, 3, "gone", "p3", "rejected", None, None, "v9", True, "a/d"),
        (4, "m", True, None, None, None, None, None, None, None, True, "a/e"),
    ]
    runs = [("r3", {"lineage.algorithm": "forest", "lineage.dataset_version_id": "v3"}), ("none", None)]
    got = {r["request_id"]: r for r in gv.deployment_records(spark.createDataFrame(rows, schema), spark.createDataFrame(runs, "run_id string, tags map<string,string>")).collect()}
    m = got[1]["model"]
    assert (m["stage"], m["run_id"], m["algorithm"], m["dataset_version_id"], m["local_artifact_path"]) == ("Production", "r3", "forest", "v3", "a/b")
    assert got[1]["readiness"]["status"] == "ready" and got[1]["promotion"]["comparison_verdict"] == "improvement"
    assert (got[2]["model"]["run_id"], got[2]["model"]["stage"], got[2]["model"]["dataset_version_id"]) == ("p2", None, "v9")
    assert got[2]["readiness"]["warnings"] == ["local_artifact_missing"] and got[2]["model"]["local_artifact_path"] is None
    assert got[3]["model"]["algorithm"] is None and got[3]["readiness"]["status"] == "promotion_not_approved"
    assert got[4]["model"]["run_id"] is None and got[4]["model"]["local_artifact_path"] is None and got[4]["readiness"]["warnings"] == ["promotion_decision_missing"]
