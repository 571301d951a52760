"""Rows that must not go missing."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidegauge.config import DataContract
from tidegauge.operators.as_of import as_of
from tidegauge.operators.contract import assert_contract, contract_report, row_count_check
from tidegauge.operators.governance import production_metrics, register_versions
from tidegauge.operators.training import random_forest_classifier


def test_as_of_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([(1, "m", "2024-01-02"), (2, None, "2024-01-02"), (3, "m", None)], "id int, model string, at string")
    right = spark.createDataFrame([("m", "2024-01-01", 7)], "model string, since string, v int")
    left, right = left.withColumn("at", F.to_timestamp("at")), right.withColumn("since", F.to_timestamp("since"))
    got = {r["id"]: r["match"] and r["match"]["v"] for r in as_of(left, right, ["model"], "at", "since").collect()}
    assert got == {1: 7, 2: None, 3: None}


def test_an_empty_table_fails_its_row_count(spark):
    contract = DataContract(name="c", types={"x": "float"}, target="y", min_rows=10)
    empty = spark.createDataFrame([], "x double, y string")
    assert [tuple(r) for r in row_count_check(empty, contract).collect()] == [("all", 0, 10, False)]
    missing = contract_report(spark.createDataFrame([(1.0,)], "x double"), contract).collect()
    assert ("missing_column", "y") in {(r["check"], r["column"]) for r in missing}


def test_an_absent_split_fails_its_contract(spark):
    contract = DataContract(name="c", types={"x": "float"}, target="y", min_rows=1)
    rows = spark.createDataFrame([(1.0, "a", "train"), (2.0, "b", "extra")], "x double, y string, split string")
    got = {r["split"]: (r["observed"], r["ok"]) for r in row_count_check(rows, contract, "split").collect()}
    assert got == {"train": (1, True), "extra": (1, True), "val": (0, False), "test": (0, False)}
    with pytest.raises(ValueError, match="min_rows"):
        assert_contract(rows, contract, "split")
    assert row_count_check(rows, replace(contract, splits=()), "split").where("not ok").isEmpty()


def test_metric_names_are_whole(spark):
    name = "m" * 1200
    versions = spark.createDataFrame([("a", 1, "r", "Production")], "model string, version int, run_id string, stage string")
    from tidegauge.operators.governance import METRIC_PREFIX

    metrics = spark.createDataFrame([("r", METRIC_PREFIX + name, 1.0)], "run_id string, key string, value double")
    assert production_metrics(versions, metrics).first()["metric"] == name


def test_a_depth_beyond_sparks_is_refused():
    with pytest.raises(ValueError):
        random_forest_classifier({"max_depth": 60}, 1, 10)


def test_requests_without_a_time_get_the_last_versions(spark):
    versions = spark.createDataFrame([("m", 4, "old")], "model string, version int, run_id string")
    rows = [("m", "z", None), ("m", "y", None), ("m", "b", "2024-01-02"), ("m", "a", "2024-01-05"), ("n", "x", None), ("m", "old", None)]
    requests = spark.createDataFrame(rows, "model string, run_id string, requested_at string").withColumn("requested_at", F.to_timestamp("requested_at"))
    got = {(r["model"], r["run_id"]): (r["version"], r["is_new"]) for r in register_versions(requests, versions).collect()}
    assert got == {
        ("m", "old"): (4, False), ("m", "b"): (5, True), ("m", "a"): (6, True), ("m", "y"): (7, True), ("m", "z"): (8, True), ("n", "x"): (1, True)
    }
