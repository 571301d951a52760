"""Named queries: models trained with Spark ML on whole tables, and scored batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import metrics as mt
from tidegauge.operators import training as tr
from tidegauge.plans.catalog import derived, query, r6

LINES = """select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice, l_returnflag from lineitem"""
NUMBERS = ["l_quantity", "l_discount", "l_tax"]


def _train(spark: SparkSession, sf_dir: str, algorithm: str, task: str, target: str, hp: dict, features=NUMBERS):
    rows = derived(spark, sf_dir, LINES)
    feature_map = {"output_features": features, "target": target}
    return rows, tr.train_tabular(rows.select(*features, target), feature_map, algorithm, task, hp)


def _class_report(spark: SparkSession, sf_dir: str, algorithm: str, hp: dict) -> DataFrame:
    rows = derived(spark, sf_dir, "select o_orderkey, o_totalprice, o_custkey, o_totalprice > 250000 as is_large from orders")
    prepared = rows.select(
        (F.col("o_totalprice") / 1e5).alias("price"), (F.col("o_custkey") % 10).cast("double").alias("noise"), F.col("is_large").cast("string").alias("y")
    )
    result = tr.train_tabular(prepared, {"output_features": ["price", "noise"], "target": "y"}, algorithm, "classification", hp)
    scored = result.model.transform(prepared)
    return mt.classification_metrics(scored.withColumn("model", F.lit(algorithm)), "y", "prediction", ["model"])


@query("train_random_forest")
def train_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_report(spark, sf_dir, "random_forest", {"n_estimators": 10, "max_depth": 4})


@query("train_logistic")
def train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_report(spark, sf_dir, "logistic_regression", {"max_iter": 50})


@query(
    "train_linear",
    """select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
        count(*) as train_rows from lineitem""",
)
def train_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, result = _train(spark, sf_dir, "linear_regression", "regression", "l_extendedprice", {}, ["l_quantity"])
    fitted = result.model.stages[-1]
    return spark.createDataFrame(
        [(round(float(fitted.coefficients[0]), 4), round(float(fitted.intercept), 3), result.train_rows)],
        "slope double, intercept double, train_rows long",
    )


@query("train_gbt")
def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured trees, none left out, and their error over all rows."""
    rows, result = _train(spark, sf_dir, "gradient_boosting", "regression", "l_extendedprice", {})
    scored = result.model.transform(rows.select(*NUMBERS, "l_extendedprice")).withColumn("model", F.lit("gbt"))
    return mt.regression_metrics(scored, "l_extendedprice", "prediction", ["model"])


STUMP_RATE, STUMP_PENALTY, STUMPS = 0.5, 2000.0, 2


def stump_sql(step: int) -> str:
    """One boosted stump on the quantity: the cut with the largest gain in squares, penalised values of both sides."""
    was = f"m{step - 1}"
    return f"""r{step} as (select q, n, s - n * {was}.m as g, {was}.m from {was}),
    c{step} as (select q, sum(g) over w as gl, sum(n) over w as nl, sum(g) over () as gt, sum(n) over () as nt from r{step}
        window w as (order by q)),
    b{step} as (select q as cut, gl / (nl + {STUMP_PENALTY}) as lv, (gt - gl) / (nt - nl + {STUMP_PENALTY}) as rv from c{step}
        where nl < nt order by gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) desc limit 1),
    m{step} as (select q, n, r{step}.g + n * r{step}.m as s, r{step}.m + {STUMP_RATE} * case when q <= cut then lv else rv end as m from r{step}, b{step})"""


@query(
    "train_gbt_stumps",
    f"""with m0 as (select l_quantity::double as q, count(*)::double as n, sum(l_extendedprice)::double as s,
        (select avg(l_extendedprice) from lineitem)::double as m from lineitem group by 1),
    {", ".join(stump_sql(i) for i in range(1, STUMPS + 1))}
    select q as quantity, round(m, 2) + 0.0 as prediction from m{STUMPS}""",
)
def train_gbt_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees of depth 1 with a penalty large enough to be seen, for every quantity."""
    hp = {"max_iter": STUMPS, "max_depth": 1, "learning_rate": STUMP_RATE, "l2_regularization": STUMP_PENALTY}
    rows, result = _train(spark, sf_dir, "gradient_boosting", "regression", "l_extendedprice", hp, ["l_quantity"])
    scored = result.model.transform(rows.select("l_quantity").distinct())
    return scored.select(F.col("l_quantity").cast("double").alias("quantity"), r6("prediction", 2).alias("prediction"))


@query("train_tabular")
def train_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run record of a trained model."""
    rows, result = _train(spark, sf_dir, "random_forest", "regression", "l_extendedprice", {"n_estimators": 3, "max_depth": 3})
    return tr.run_records(rows, [result], ["run-1"]).select("run_id", F.explode("params").alias("param", "value"))


@query(
    "model_run_record",
    """select 'run-1' as run_id, unnest(['algorithm', 'task_type', 'dataset_version_id', 'random_seed', 'train_rows', 'trained_at', 'hp.max_depth',
            'hp.n_estimators', 'hp.class_weight', 'unused_hp.min_samples_split']) as param,
        unnest(['random_forest', 'regression', '', '42', (select count(*)::varchar from lineitem), 'a time', '2', '2', 'balanced', '2']) as value""",
)
def model_run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a model trained here; its time is only checked for being one."""
    rows, result = _train(spark, sf_dir, "random_forest", "regression", "l_extendedprice", {"n_estimators": 2, "max_depth": 2})
    params = tr.run_records(rows, [result], ["run-1"]).select("run_id", F.explode("params").alias("param", "value"))
    is_time = (F.col("param") == "trained_at") & F.to_timestamp("value").isNotNull()
    return params.withColumn("value", F.when(is_time, "a time").otherwise(F.col("value")))


@query(
    "batch_score",
    """with f as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem)
    select l_orderkey, l_linenumber, l_tax = 0.08 as rejected, case when l_tax <> 0.08 then round(a * l_quantity + b, 2) end as value
    from lineitem, f""",
)
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, result = _train(spark, sf_dir, "linear_regression", "regression", "l_extendedprice", {}, ["l_quantity"])
    text = rows.withColumn("l_quantity", F.when(F.col("l_tax") == 0.08, "n/a").otherwise(F.col("l_quantity").cast("string")))
    keys = ["l_orderkey", "l_linenumber"]
    scored, rejected = tr.score_batch(text, result.model, ["l_quantity"], "regression", keys)
    good = scored.select(*keys, F.lit(False).alias("rejected"), r6("value", 2).alias("value"))
    return good.unionByName(rejected.select(*keys, F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("value")))
