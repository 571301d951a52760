import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.config import DriftConfig
from tidegauge.functions.severity import feature_severity, overall_severity, raises_alert, trips_gate
from tidegauge.functions.stats import chi_square_tail
from tidegauge.operators import drift_report as dr
from tidegauge.operators import two_sample as ts
from tidegauge.plans.monitor import monitor


def ks_distance(a, b):
    a, b = np.sort(a), np.sort(b)
    x = np.concatenate([a, b])
    return np.max(np.abs(np.searchsorted(a, x, "right") / len(a) - np.searchsorted(b, x, "right") / len(b)))


def earth_mover(a, b):
    a, b = np.sort(a), np.sort(b)
    x = np.sort(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(a, x[:-1], "right") / len(a) - np.searchsorted(b, x[:-1], "right") / len(b))
    return float(np.sum(gap * np.diff(x)))


def frames(spark, ref, batches):
    left = spark.createDataFrame(pd.DataFrame({"x": np.asarray(ref, dtype=float)}))
    rows = pd.concat([pd.DataFrame({"b": k, "x": np.asarray(v, dtype=float)}) for k, v in batches.items()])
    return left, spark.createDataFrame(rows)


@pytest.mark.parametrize("buckets", [1, 2, 5, 200])
def test_distances_equal_brute_force_for_any_bucket_count(spark, buckets):
    rng = np.random.default_rng(3)
    ref = np.round(rng.normal(10, 2, 400), 1)
    batches = {
        "same": ref,
        "shifted": np.round(rng.normal(12, 2, 150), 1),
        "hot": np.concatenate([np.full(300, 9.5), rng.normal(10, 3, 100)]),
        "far": rng.uniform(100, 101, 50),
        "one": [10.0],
    }
    left, right = frames(spark, ref, batches)
    counts = ts.samples(left, right, ["x"], "b", buckets)
    ks = {r["batch"]: r["statistic"] for r in ts.ks(counts).collect()}
    wd = {r["batch"]: r for r in ts.wasserstein(counts).collect()}
    for name, values in batches.items():
        assert ks[name] == pytest.approx(ks_distance(ref, np.asarray(values)), abs=1e-12)
        assert wd[name]["statistic"] == pytest.approx(earth_mover(ref, np.asarray(values)), abs=1e-9)
        assert wd[name]["scaled"] == pytest.approx(earth_mover(ref, np.asarray(values)) / ref.std(), abs=1e-9)
    assert ks["same"] == 0 and ks["far"] == 1


@pytest.mark.parametrize("buckets,salts", [(1, 3), (4, 3)])
def test_many_batches_dealt_over_salts(spark, buckets, salts):
    """Batches that share one hot value, dealt with copies of the reference: the same numbers for each."""
    rng = np.random.default_rng(8)
    ref = np.round(rng.normal(0, 2, 300), 1)
    batches = {f"b{i}": np.concatenate([np.full(20, 0.5), np.round(rng.normal(i / 20, 2, 5 + i % 7), 1)]) for i in range(40)}
    left, right = frames(spark, ref, batches)
    data = ts.samples(left, right, ["x"], "b", buckets, salts)
    ks = {r["batch"]: r for r in ts.ks(data).collect()}
    wd = {r["batch"]: r["statistic"] for r in ts.wasserstein(data).collect()}
    assert set(ks) == set(wd) == set(batches)
    for name, values in batches.items():
        assert (ks[name]["n"], ks[name]["m"]) == (300, len(values))
        assert ks[name]["statistic"] == pytest.approx(ks_distance(ref, values), abs=1e-12)
        assert wd[name] == pytest.approx(earth_mover(ref, values), abs=1e-9)


def test_cells_are_the_same_however_they_are_dealt(spark):
    left = spark.createDataFrame([("abcdefg"[i * i % 7],) for i in range(90)], "x string")
    right = spark.createDataFrame([(f"b{i % 9}", "abcxyz"[i * 5 % 6]) for i in range(200)], "b string, x string")
    counts = ts.value_counts(left, right, ["x"], "b", "string")

    def rows(df):
        return {r["batch"]: [round(v, 9) for v in r if isinstance(v, (int, float))] for r in df.collect()}

    assert rows(ts.chi_square(counts)) == rows(ts.chi_square(counts, salts=4)) == rows(ts.chi_square(counts, few=True))
    whole = rows(ts.share_distances(counts))
    assert whole == rows(ts.share_distances(counts, salts=4, parts=3)) == rows(ts.share_distances(counts, few=True))


@pytest.mark.parametrize("test", ["ks", "psi", "jensenshannon", "wasserstein", "chisquare"])
def test_infinities_are_missing_and_stay_where_they_are(spark, test):
    rng = np.random.default_rng(2)
    ref, clean, other = rng.normal(size=80), rng.normal(size=40), rng.normal(1, 1, 30)
    config = DriftConfig(numeric_test=test, numeric_threshold=0.1)

    def scores(ref, batches):
        got = monitor(*frames(spark, ref, batches), ["x"], "b", config).collect()
        return {r["batch"]: (r["features"]["x"]["drift_score"], r["features"]["x"]["severity"], list(r["warnings"])) for r in got}

    before = scores(ref, {"clean": clean, "other": other})
    after = scores(ref, {"clean": clean, "other": np.append(other, [math.inf, -math.inf]), "none": np.full(30, math.inf)})
    assert after["clean"] == before["clean"] and after["other"][:2] == before["other"][:2]
    assert after["other"][2] == ["non_finite:x"] and after["none"] == (None, "high", ["missing_feature:x", "non_finite:x"])
    spoiled = scores(np.append(ref, math.inf), {"clean": clean})
    assert spoiled["clean"] == (*before["clean"][:2], ["non_finite:x"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.integers(-5, 5), min_size=1, max_size=25),
    st.lists(st.integers(-5, 5), min_size=1, max_size=25),
    st.sampled_from([1, 3]),
)
def test_distances_on_small_integers(spark, ref, cur, buckets):
    left, right = frames(spark, ref, {"b": cur})
    counts = ts.samples(left, right, ["x"], "b", buckets)
    assert ts.ks(counts).first()["statistic"] == pytest.approx(ks_distance(np.array(ref), np.array(cur)), abs=1e-12)
    assert ts.wasserstein(counts).first()["statistic"] == pytest.approx(earth_mover(np.array(ref), np.array(cur)), abs=1e-9)


def test_missing_values_leave_the_feature_not_the_batch(spark):
    left, right = frames(spark, [1, 2, 3, float("nan")], {"b": [1, float("nan"), 2, 3]})
    row = ts.ks(ts.samples(left, right, ["x"], "b", 1)).first()
    assert (row["n"], row["m"], row["statistic"], row["p_value"]) == (3, 3, 0.0, 1.0)


def test_constant_reference(spark):
    left, right = frames(spark, [5, 5, 5], {"b": [5, 7]})
    row = ts.wasserstein(ts.samples(left, right, ["x"], "b", 1)).first()
    assert row["statistic"] == pytest.approx(1.0) and row["scaled"] == pytest.approx(1.0)
    cells = ts.bin_counts(left, right, ["x"], "b", 10)
    assert ts.share_distances(cells).first()["psi"] == pytest.approx(0.0)


def test_chi_square_with_unseen_and_absent_categories(spark):
    left = spark.createDataFrame([("a",)] * 60 + [("b",)] * 30 + [("c",)] * 10, "x string")
    right = spark.createDataFrame([("m", "a")] * 5 + [("m", "z")] * 5 + [("same", "a")] * 6 + [("same", "b")] * 3 + [("same", "c")], "b string, x string")
    rows = {r["batch"]: r for r in ts.chi_square(ts.value_counts(left, right, ["x"], "b", "string")).collect()}
    expected = (5 - 6) ** 2 / 6 + 3 + 1 + (5 - 0.5) ** 2 / 0.5
    assert rows["m"]["statistic"] == pytest.approx(expected) and rows["m"]["df"] == 3
    assert rows["same"]["statistic"] == pytest.approx(0.0) and rows["same"]["p_value"] == pytest.approx(1.0)


def test_chi_square_single_category(spark):
    left, right = spark.createDataFrame([("a",)], "x string"), spark.createDataFrame([("m", "a")], "b string, x string")
    row = ts.chi_square(ts.value_counts(left, right, ["x"], "b", "string")).first()
    assert (row["statistic"], row["df"], row["p_value"]) == (0.0, 0, 1.0)


@pytest.mark.parametrize("x,df", [(0.5, 1), (3.84, 1), (10.0, 4), (50.0, 6), (0.0, 3), (900.0, 2)])
def test_chi_square_tail(x, df):
    if df % 2 == 0:
        want = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))
    elif df == 1:
        want = math.erfc(math.sqrt(x / 2))
    else:
        want = 1.0
    assert chi_square_tail(x, df) == pytest.approx(want, rel=1e-9)


def test_share_distances_by_hand(spark):
    left = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5, "x string")
    right = spark.createDataFrame([("m", "a")] * 8 + [("m", "c")] * 2, "b string, x string")
    row = ts.share_distances(ts.value_counts(left, right, ["x"], "b", "string")).first()
    p, q = np.array([0.5, 0.5, 1e-4]), np.array([0.8, 1e-4, 0.2])
    mid = (p + q) / 2
    assert row["psi"] == pytest.approx(float(((p - q) * np.log(p / q)).sum()))
    js = math.sqrt(float((p * np.log(p / mid) + q * np.log(q / mid)).sum()) / 2)
    assert row["jensenshannon"] == pytest.approx(js)


def test_registered_test_and_unknown_test(spark):
    left, right = frames(spark, [1, 2, 3], {"b": [1, 2]})
    ts.register_stat_test("always", lambda s, c: s.counts().where("batch is not null").select("feature", "batch").distinct().withColumn("score", F.lit(0.0)))
    out = dr.feature_table(left, right, ["x"], "b", DriftConfig(numeric_test="always")).first()
    assert out["drift_detected"] and out["stattest_name"] == "always"
    with pytest.raises(ValueError, match="unknown drift test"):
        dr.feature_table(left, right, ["x"], "b", DriftConfig(numeric_test="nope"))
    with pytest.raises(ValueError, match="numeric"):
        cat = left.select(F.col("x").cast("string").alias("x"))
        dr.feature_table(cat, right.select("b", F.col("x").cast("string").alias("x")), ["x"], "b", DriftConfig(categorical_test="ks"))


def test_severity_edges(spark):
    c = DriftConfig()
    rows = spark.createDataFrame([(0.0009, True), (0.001, True), (0.0099, True), (0.01, True), (0.0, False)], "p double, d boolean")
    got = [r[0] for r in rows.select(feature_severity(F.col("p"), F.col("d"), F.lit("ks"), c)).collect()]
    assert got == ["high", "medium", "medium", "low", "low"]
    far = spark.createDataFrame([(0.24,), (0.25,), (0.09,), (0.1,)], "s double")
    got = [r[0] for r in far.select(feature_severity(F.col("s"), F.lit(True), F.lit("psi"), c)).collect()]
    assert got == ["medium", "high", "low", "medium"]
    shares = spark.createDataFrame([(0.25,), (0.26,), (0.5,), (0.51,)], "s double")
    assert [r[0] for r in shares.select(overall_severity(F.col("s"), c)).collect()] == ["low", "medium", "medium", "high"]


def test_alert_and_gate(spark):
    rows = spark.createDataFrame([("low",), ("medium",), ("high",), ("odd",)], "s string")
    s = F.col("s")
    assert [r[0] for r in rows.select(raises_alert(s, "medium")).collect()] == [False, True, True, False]
    assert [r[0] for r in rows.select(trips_gate(s, "medium")).collect()] == [False, True, True, False]
    assert [r[0] for r in rows.select(trips_gate(s, "never")).collect()] == [False] * 4
    assert [r[0] for r in rows.select(trips_gate(s, "low", interactive=True)).collect()] == [False] * 4
    assert [r[0] for r in rows.select(trips_gate(s, "what")).collect()] == [False] * 4


def test_alignment(spark):
    ref = spark.createDataFrame([(1.0, "a")], "x double, c string")
    cur = spark.createDataFrame([("1", "a", 2)], "x string, c string, extra int")
    found = dr.alignment(ref, cur, ["x", "c"])
    assert ("error", "type_mismatch") in {f[:2] for f in found} and ("warning", "extra_column") in {f[:2] for f in found}
    assert dr.alignment(ref, cur.drop("c"), ["x", "c"])[0][:3] == ("error", "missing_in_batch", "c")
    assert dr.alignment(ref, cur, [])[0][1] == "no_features"
    empty = dr.alignment_table(ref, ref.limit(0), ["x", "c"]).collect()
    assert [r["check"] for r in empty] == ["empty_batch"]
    with pytest.raises(ValueError, match="alignment failed"):
        dr.require_alignment(ref, cur, ["x", "c"])


def test_monitor_record(spark):
    rng = np.random.default_rng(1)
    base = pd.DataFrame({"num": rng.normal(size=100), "cat": rng.choice(list("abc"), 100), "flag": rng.random(100) > 0.5})
    ref = spark.createDataFrame(base)
    shifted = base.assign(num=base["num"] + 5, b="shift")
    rows = spark.createDataFrame(pd.concat([base.assign(b="same"), shifted, base.head(9).assign(b="tiny"), base.head(20).assign(b="small")]))
    got = {r["batch"]: r for r in monitor(ref, rows, ["num", "cat"], "b").collect()}
    assert set(got) == {"same", "shift", "small"}  # nine rows are too few for a result
    assert got["same"]["overall"]["drifted_feature_count"] == 0 and not got["same"]["alert"]
    shift = got["shift"]
    assert shift["features"]["num"]["severity"] == "high" and shift["features"]["num"]["column_type"] == "num"
    assert shift["features"]["cat"]["column_type"] == "cat" and shift["features"]["cat"]["stattest_name"] == "chisquare"
    assert shift["overall"]["drift_share"] == 0.5 and shift["overall"]["dataset_drift_detected"] and shift["overall"]["severity"] == "medium"
    assert shift["alert"] and not shift["gate"]
    assert shift["method"] == "ks/chisquare" and shift["schema_version"] == "1.1.0" and shift["warnings"] == []
    assert got["small"]["warnings"] == ["small_sample"]
    assert shift["severity_counts"].asDict() == {"low": 1, "medium": 0, "high": 1}
    assert shift["reference_dataset"]["row_count"] == 100 and shift["current_dataset"]["feature_count"] == 2
    strict = monitor(ref, rows, ["num", "cat"], "b", DriftConfig(drift_share=0.9)).where("batch = 'shift'").first()
    assert not strict["overall"]["dataset_drift_detected"]


@pytest.mark.parametrize("test", ["ks", "psi", "wasserstein"])
def test_no_feature_and_no_batch_is_lost(spark, test):
    """A feature or a whole batch without values stays in the record; one that neither side has does not drift."""
    shape = "x double, c string, none double, b string"
    ref = spark.createDataFrame([(float(i % 10), "ab"[i % 2], None) for i in range(100)], "x double, c string, none double")
    side = {"full": (1.0, "a"), "nox": (None, "a"), "nan": (float("nan"), "a"), "empty": (None, None)}
    rows = [(x and x * (i % 10), c and "ab"[i % 2], None, b) for b, (x, c) in side.items() for i in range(40)]
    config = DriftConfig(numeric_test=test, numeric_threshold=0.05 if test == "ks" else 0.1)
    got = {r["batch"]: r for r in monitor(ref, spark.createDataFrame(rows, shape), ["x", "c", "none"], "b", config).collect()}
    assert set(got) == set(side)
    assert all(r["overall"]["total_feature_count"] == 3 and set(r["features"]) == {"x", "c", "none"} for r in got.values())
    lost = {"full": [], "nox": ["x"], "nan": ["x"], "empty": ["c", "x"]}
    for name, record in got.items():
        assert record["warnings"] == [f"missing_feature:{f}" for f in lost[name]]
        assert record["overall"]["drifted_feature_count"] == len(lost[name])
        for f in lost[name]:
            entry = record["features"][f]
            assert entry["drift_score"] is None and entry["drift_detected"] and entry["severity"] == "high"
        assert record["features"]["none"]["drift_score"] is None and not record["features"]["none"]["drift_detected"]
    assert got["empty"]["overall"]["severity"] == "high" and got["empty"]["alert"]


def test_hot_value_is_one_row_after_counting(spark):
    ref = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    cur = ref.withColumn("b", F.lit("b"))
    counts = ts.value_counts(ref, cur, ["x"], "b", "double")
    assert counts.where("value = 7.0").count() == 2
    assert ts.ks(ts.samples(ref, cur, ["x"], "b", 6)).first()["statistic"] == 0.0
