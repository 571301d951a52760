import time

import numpy as np
import pandas as pd
import pytest

from tidegauge.config import DriftConfig
from tidegauge.plans.monitor import monitor_features
from tidegauge.streaming.arrivals import monitor_arrivals

CONFIG = DriftConfig(numeric_test="psi", numeric_threshold=0.1)


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(6)

    def rows(n, model, shift=0.0, **more):
        x = np.where(rng.random(n) < 0.05, np.nan, rng.normal(shift, 1 + (model == "b"), n))
        return pd.DataFrame({"x": x, "c": rng.choice(["p", "q", None] if model == "a" else ["q", "r"], n), "model": model, **more})

    ref = pd.concat([rows(300, "a"), rows(200, "b", 4.0)])
    cur = pd.concat(
        [rows(90, m, s, day=d) for m, d, s in (("a", "one", 0.0), ("a", "two", 2.0), ("b", "one", 4.0), ("b", "two", 0.0))]
        + [rows(4, "a", day="tiny")]
    )
    cur["total"] = cur.groupby(["model", "day"])["x"].transform("size")
    return ref, cur.sample(frac=1, random_state=1).reset_index(drop=True)


def run(spark, tmp_path, ref, **options):
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    args = (["x", "c"], "day", str(tmp_path / "history"), str(tmp_path / options.pop("checkpoint", "ck")), CONFIG)
    return monitor_arrivals(stream, spark.createDataFrame(ref), *args, **options)


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def history(spark, tmp_path):
    columns = ["model", "batch", "feature", "severity", "drift_detected", "overall_severity", "drift_score"]
    rows = spark.read.parquet(str(tmp_path / "history")).select(*columns).collect()
    return sorted((*r[:-1], None if r[-1] is None else round(r[-1], 9)) for r in rows)


def in_one(spark, ref, cur):
    out = []
    for model in ("a", "b"):
        own = [spark.createDataFrame(d[d["model"] == model]) for d in (ref, cur)]
        for r in monitor_features(*own, ["x", "c"], "day", CONFIG).collect():
            out.append((model, r["batch"], r["feature"], r["severity"], r["drift_detected"], r["overall_severity"], round(r["drift_score"], 9)))
    return sorted(out)


def test_three_parts_give_the_record_of_the_whole_and_a_replay_nothing(spark, tmp_path, sides):
    ref, cur = sides
    for part in np.array_split(cur, 3):
        put(spark, tmp_path, part)
    run(spark, tmp_path, ref, expected="total").awaitTermination()
    want = in_one(spark, ref, cur)
    assert len(want) == 8 and history(spark, tmp_path) == want  # four batches of two features; four rows are too few
    run(spark, tmp_path, ref, expected="total").awaitTermination()  # nothing new
    run(spark, tmp_path, ref, expected="total", checkpoint="again").awaitTermination()  # every micro-batch again, into its own folder
    assert history(spark, tmp_path) == want
    put(spark, tmp_path, cur.head(5))
    run(spark, tmp_path, ref, expected="total").awaitTermination()
    late = spark.read.parquet(str(tmp_path / "history-late")).groupBy().sum("late_rows").first()[0]
    assert late == 5 and history(spark, tmp_path) == want


def test_a_row_or_silence_ends_a_batch(spark, tmp_path, sides):
    ref, cur = sides
    cur = cur[cur["day"] == "two"].assign(last=False)
    a, b = cur[cur["model"] == "a"], cur[cur["model"] == "b"].copy()
    b.iloc[-1, b.columns.get_loc("last")] = True
    put(spark, tmp_path, pd.concat([a, b.head(40)]))
    put(spark, tmp_path, b.tail(50))
    query = run(spark, tmp_path, ref, closed="last", idle_seconds=2.0)
    want, until = in_one(spark, ref, cur), time.monotonic() + 90
    try:
        while time.monotonic() < until and not ((tmp_path / "history").exists() and len(history(spark, tmp_path)) == len(want)):
            time.sleep(2)
    finally:
        query.stop()
    assert history(spark, tmp_path) == want


def test_tests_that_need_every_value_are_refused(spark, sides):
    ref = spark.createDataFrame(sides[0])
    with pytest.raises(ValueError, match="every value"):
        monitor_arrivals(ref, ref, ["x"], "day", "h", "c", DriftConfig(numeric_test="ks"))


def test_ranges_are_taken_once_and_bring_no_model_to_one_task(spark, tmp_path, sides, monkeypatch):
    from tidegauge.streaming import arrivals

    met, whole = [], arrivals.celled
    monkeypatch.setattr(arrivals, "celled", lambda *args: met.append(whole(*args)) or met[-1])
    ref, cur = sides
    put(spark, tmp_path, cur.assign(total=cur.groupby(["model", "day"])["day"].transform("size")))
    run(spark, tmp_path, ref, expected="total").awaitTermination()
    plans = [df._jdf.queryExecution().logical().toString() for df in met]
    assert len(plans) == 2 and all("strategy=broadcast" in p and "Aggregate" not in p for p in plans)
    assert history(spark, tmp_path) == in_one(spark, ref, cur)
    monkeypatch.setattr(arrivals, "BROADCAST_MODELS", 1)
    assert "Hint" not in arrivals.kept_ranges(arrivals.ranges(spark.createDataFrame(ref), ["x", "c"]))._jdf.queryExecution().logical().toString()
