import pytest
from pyspark.sql import functions as F

from tidegauge.config import DataContract
from tidegauge.operators import contract as ct
from tidegauge.operators import fingerprint as fp
from tidegauge.operators import split as sp

CONTRACT = DataContract("iris", "species", {"a": "float", "n": "int", "species": "string"}, min_rows=3, max_null_fraction=0.25, label_classes=("x", "y"))


def rows(spark, data):
    return spark.createDataFrame(data, "a double, n long, species string")


def test_contract_passes_and_fails_with_every_message(spark):
    ct.assert_contract(rows(spark, [(1.0, 1, "x"), (2.0, 2, "y"), (None, 3, "x"), (4.0, 4, "y")]), CONTRACT)
    with pytest.raises(ValueError) as error:
        ct.assert_contract(rows(spark, [(float("nan"), 1, "z"), (2.0, None, None)]).drop("n"), CONTRACT)
    text = str(error.value)
    for part in ("min_rows", "null_fraction a", "missing_column n", "unknown labels: z"):
        assert part in text
    assert "null_fraction species: 0.5" in text


def test_null_fraction_limit_is_inclusive(spark):
    table = ct.null_fraction_check(rows(spark, [(None, 1, "x")] + [(1.0, 1, "x")] * 3), CONTRACT)
    assert {r["column"]: r["ok"] for r in table.collect()} == {"a": True, "n": True, "species": True}


def test_dtypes_and_inference(spark):
    df = spark.createDataFrame([(1, 2.5, True, "s")], "i int, f float, b boolean, s string")
    assert [t for _, t, _ in ct.infer_columns(df, "s")] == ["int", "float", "bool", "string"]
    wrong = DataContract("w", "s", {"i": "float", "f": "float", "b": "date"})
    assert ct.dtype_findings(df, wrong) == [("i", "float", "int", False), ("f", "float", "float", True)]
    inferred = ct.infer_contract(df, "d", "s")
    assert inferred.label_classes == ("s",) and inferred.min_rows == 10
    ct_reg = DataContract("r", "s", {"s": "string"}, task_type="regression", label_classes=("q",))
    assert ct.unknown_labels(df, ct_reg).count() == 0


def test_class_counts_lists_empty_classes(spark):
    listing = spark.createDataFrame([("/d/x/1.png", "x"), ("/d/x/2.PNG", "x"), ("/d/x/3.txt", "x")], "path string, label string")
    got = {r["label"]: (r["n"], r["ok"]) for r in ct.class_counts(listing, DataContract("i", "l", {}, label_classes=("x", "y"), min_images_per_class=2)).collect()}
    assert got == {"x": (2, True), "y": (0, False)}


def test_fingerprint_depends_on_content_only(spark):
    df = spark.createDataFrame([(1, "a\r\nb", None), (2, "c", 1.0), (2, "c", 1.0)], "k long, t string, v double")
    one = fp.dataset_fingerprint(df).first()
    assert one == fp.dataset_fingerprint(df.repartition(3).orderBy(F.desc("k"))).first()
    same = df.withColumn("t", F.replace("t", F.lit("\r\n"), F.lit("\n")))
    assert fp.dataset_fingerprint(same).first() == one
    for changed in (df.distinct(), df.withColumn("t", F.lit("c")), df.fillna(0.0), df.withColumnRenamed("v", "w")):
        assert fp.dataset_fingerprint(changed).first()["version"] != one["version"]
    assert len(one["version"]) == 12


def test_folder_fingerprint(spark):
    files = spark.createDataFrame([("file:/r/x/a.png", 3), ("file:/r/y/b.PNG", 4), ("file:/r/notes.txt", 9)], "path string, length long")
    one = fp.folder_fingerprint(files, "/r", (".png",)).first()
    assert one["files"] == 2
    moved = files.withColumn("path", F.replace("path", F.lit("/r/"), F.lit("/other/")))
    assert fp.folder_fingerprint(moved, "/other", (".png",)).first() == one
    grown = files.withColumn("length", F.col("length") + 1)
    assert fp.folder_fingerprint(grown, "/r", (".png",)).first()["version"] != one["version"]


def test_latest_and_mismatch(spark):
    v = spark.createDataFrame([("d", "a", 1), ("d", "b", 3), ("e", "c", 2)], "ds string, v string, at long")
    newest = fp.latest_version(v, "ds", "v", "at")
    assert {r["dataset"]: r["version"] for r in newest.collect()} == {"d": "b", "e": "c"}
    flags = fp.version_mismatch(v.withColumnRenamed("ds", "dataset").withColumnRenamed("v", "version").drop("at"), newest.drop("at"), "dataset", "version")
    assert sorted(r["version_mismatch"] for r in flags.collect()) == [False, False, True]


def labelled(spark, sizes):
    data = [(f"{label}{i}", label) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "key string, label string")


def test_stratified_split_cuts_exactly(spark):
    df = labelled(spark, {"a": 300, "b": 100, "c": 7, "solo": 1, None: 20})
    out = sp.split_stratified(df, "label", "key").cache()
    assert out.count() == df.count() and out.select("key").distinct().count() == df.count()
    got = {(r["label"], r["split"]): r["n"] for r in out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert (got["a", "train"], got["a", "val"], got["a", "test"]) == (210, 45, 45)
    assert (got["b", "train"], got["b", "val"], got["b", "test"]) == (70, 15, 15)
    assert (got["c", "train"], got["c", "val"], got["c", "test"]) == (5, 1, 1)
    assert (got[None, "train"], got[None, "val"], got[None, "test"]) == (14, 3, 3)
    assert sorted(out.collect()) == sorted(sp.split_stratified(df.repartition(5), "label", "key").collect())
    other = sp.split_stratified(df, "label", "key", seed=7)
    assert sorted(other.collect()) != sorted(out.collect())


def test_zero_val_ratio_gives_an_empty_val(spark):
    out = sp.split_stratified(labelled(spark, {"a": 10}), "label", "key", train_ratio=0.8, val_ratio=0.0)
    assert {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 8, "test": 2}
    with pytest.raises(ValueError):
        sp.split_stratified(out, "label", "key", train_ratio=0.9, val_ratio=0.2)


def test_one_class_with_a_third_of_all_rows(spark):
    df = spark.range(30_000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("label"))
    counts = sp.split_stratified(df, "label", "key").where("label = 'hot'").groupBy("split").agg(F.count("*").alias("n"))
    assert {r["split"]: r["n"] for r in counts.collect()} == {"train": 7000, "val": 1500, "test": 1500}


def test_preserved_test_split(spark):
    names = [(f"train_{i}.png", "ab"[i % 2]) for i in range(20)] + [(f"TEST_{i}.png", "a") for i in range(5)]
    df = spark.createDataFrame(names, "name string, label string")
    out = sp.split_preserving_test(df, "label", "name", "name", val_ratio=0.2)
    got = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 16, "val": 4, "test": 5}
    none = sp.split_preserving_test(df, "label", "name", "name", val_ratio=0.0)
    assert {r["split"] for r in none.select("split").distinct().collect()} == {"train", "test"}
    mixed = df.unionByName(spark.createDataFrame([("other.png", "a")], df.schema))
    plain = sp.split_preserving_test(mixed, "label", "name", "name")
    assert plain.where("split = 'test' and name like 'train%'").count() > 0


def test_holdout_rules(spark):
    df = labelled(spark, {"a": 10, "b": 2, "solo": 1})
    out = sp.holdout_stratified(df, "label", "key", 0.01)
    held = {r["label"]: r["n"] for r in out.where("part = 'holdout'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert held == {"a": 1, "b": 1}  # at least one per class, a single row stays in train
    most = sp.holdout_stratified(df, "label", "key", 0.99).where("part = 'holdout' and label = 'a'").count()
    assert most == 9
    with pytest.raises(ValueError, match="at least 2"):
        sp.holdout_tabular(df.limit(1), "label", "key", 0.5)
    tab = sp.holdout_tabular(df, "label", "key", 0.5)  # a class with one row: plain random holdout
    assert tab.where("part = 'holdout'").count() == 6
    assert sp.holdout_tabular(df.limit(2), "label", "key", 0.0001).where("part = 'holdout'").count() == 1


def test_drift_slice_and_weights(spark):
    df = labelled(spark, {"a": 8, "b": 1}).withColumn("is_drifted", F.lit(True)).unionByName(labelled(spark, {"c": 27}).withColumn("is_drifted", F.lit(False)))
    part = sp.drift_val_slice(df, "label", "is_drifted", "key", 0.25)
    assert [r["label"] for r in part.collect()] == ["a", "a"]
    weights = sp.oversample_weights(df, "is_drifted", 0.4)
    total = {r["is_drifted"]: r["w"] for r in weights.groupBy("is_drifted").agg(F.sum("weight").alias("w")).collect()}
    assert total[True] / (total[True] + total[False]) == pytest.approx(0.4)
    assert sp.oversample_weights(df.where("is_drifted"), "is_drifted", 0.4).select("weight").distinct().first()[0] == 1.0
    balanced = {r["label"]: r["weight"] for r in sp.class_weights(df, "label").collect()}
    assert balanced["a"] == pytest.approx(36 / (3 * 8))


def test_resample_is_repeatable_and_follows_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("key"), F.when(F.col("id") < 1000, 3.0).otherwise(1.0).alias("w"))
    one = sp.weighted_resample(df, "w", "key", 4000)
    assert one.count() == 4000 and one.where("key < 1000").count() / 4000 == pytest.approx(0.5, abs=0.05)
    assert sorted(one.collect()) == sorted(sp.weighted_resample(df.repartition(7), "w", "key", 4000).collect())
    assert {sp.weighted_resample(df, "w", "key", 777, seed).count() for seed in range(5)} == {777}
    big = sp.weighted_resample(df.limit(10).withColumn("w", F.lit(1.0)), "w", "key", 10_000)
    assert big.count() == 10_000 and big.groupBy("key").count().count() == 10


def test_resample_down_a_deeper_tree(spark):
    df = spark.range(6000).select(F.col("id").alias("key"), F.when(F.col("id") < 600, 9.0).otherwise(1.0).alias("w"), F.lit(None).cast("int").alias("_n"))
    df = df.drop("_n")
    drawn = sp.weighted_resample(df, "w", "key", 5000, leaf_rows=1)  # two levels of branches above the rows
    assert drawn.count() == 5000 and drawn.where("key < 600").count() / 5000 == pytest.approx(0.5, abs=0.04)
    assert sorted(drawn.collect()) == sorted(sp.weighted_resample(df.repartition(5), "w", "key", 5000, leaf_rows=1).collect())


def test_resample_never_draws_rows_without_weight(spark):
    rows = [(1, 2.0), (2, 0.0), (3, None), (4, float("nan")), (5, -1.0), (6, 1e-6), (None, 2.0), (1, 2.0)]
    df = spark.createDataFrame(rows, "key int, w double")
    drawn = sp.weighted_resample(df, "w", "key", 500)
    assert drawn.count() == 500 and {r["key"] for r in drawn.collect()} <= {1, 6, None}
    assert sp.weighted_resample(df.where("w <= 0"), "w", "key", 500).count() == 0
    assert sp.weighted_resample(df, "w", "key", 0).count() == 0


def test_splits_of_few_and_many_classes_agree_and_null_keys_are_refused(spark, monkeypatch):
    df = spark.range(900).select(F.col("id").alias("key"), F.when(F.col("id") % 3 > 0, (F.col("id") % 7).cast("string")).alias("label"))
    few, many = sp.split_stratified(df, "label", "key"), sp.split_stratified(df, "label", "key", many_classes=True)
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str)
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    weights = [sp.with_class_weight(df, "label", many_classes=m).collect() for m in (False, True)]
    assert sorted(weights[0], key=str) == sorted(weights[1], key=str)
    with pytest.raises(Exception, match="key that is not null"):
        sp.split_stratified(df.withColumn("key", F.when(F.col("key") > 3, F.col("key"))), "label", "key").collect()
    monkeypatch.setattr(sp, "FEW_CLASSES", 2)
    with pytest.raises(Exception, match="many_classes=True"):
        sp.split_stratified(df, "label", "key").collect()
    assert sp.split_stratified(df, "label", "key", many_classes=True).count() == 900


def test_resample_of_high_rates_has_the_spread_of_poisson(spark):
    df = spark.range(400).select(F.col("id").alias("key"), F.lit(1.0).alias("w"))
    copies = [r["count"] for r in sp.weighted_resample(df, "w", "key", 400 * 100).groupBy("key").count().collect()]
    mean = sum(copies) / len(copies)
    assert len(copies) == 400 and mean == pytest.approx(100, abs=2)
    assert sum((c - mean) ** 2 for c in copies) / 400 == pytest.approx(100, rel=0.3)
