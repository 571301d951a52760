"""Named queries: evaluation metrics, deltas and sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import metrics as mt
from tidegauge.plans.catalog import derived, query, r6, table

# five classes, four models by order status and month parity; the prediction is off on some orders
SCORED = """
    select o_orderkey, o_orderstatus as model,
        case when month(o_orderdate) <= 8 then 'val' when month(o_orderdate) <= 11 then 'test' else 'train' end as split,
        o_orderpriority as y,
        case when o_orderkey % 5 = 0 and o_orderstatus = 'F' then '1-URGENT' when o_orderkey % 7 = 1 then '5-LOW'
             when o_custkey % 11 = 2 then '6-NEW' else o_orderpriority end as p,
        o_totalprice / 1000 as value,
        o_totalprice / 1000 * case when o_orderkey % 3 = 0 then 1.1 else 0.95 end + 0.5 as estimate
    from orders"""


def metric_sql(by: str, source: str = "s", averaging: str = "weighted") -> str:
    """Metric rows per group; f1 is 2·hits / (support + predicted)."""
    if averaging == "binary":
        avg = "coalesce(max(case when c = '1' then {} end), 0)"
    else:
        avg = "sum({} * support) / sum(support)" if averaging == "weighted" else "avg({})"
    return f"""
    sides as (select {by}, y as c, 1 as s, 0 as q, (y = p)::int as h from {source} union all select {by}, p, 0, 1, 0 from {source}),
    cls as (select {by}, c, sum(s) as support, sum(q) as predicted, sum(h) as hits from sides group by {by}, c),
    pr as (select *, coalesce(hits / nullif(predicted, 0), 0) as pre, coalesce(hits / nullif(support, 0), 0) as rec,
        2 * hits / (support + predicted) as f1 from cls),
    m as (select {by}, round_even(sum(hits) / sum(support), 4) as accuracy, round_even({avg.format('pre')}, 4) as "precision",
        round_even({avg.format('rec')}, 4) as recall, round_even({avg.format('f1')}, 4) as f1_score,
        sum(support)::bigint as n_samples from pr group by {by})"""


@query(
    "classification_metrics",
    f"with s as ({SCORED}), {metric_sql('model, split')} select * from m",
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.classification_metrics(derived(spark, sf_dir, SCORED), "y", "p", ["model", "split"])


@query(
    "classification_metrics_macro",
    f"with s as ({SCORED}), {metric_sql('model', averaging='macro')} select * from m",
)
def classification_metrics_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.classification_metrics(derived(spark, sf_dir, SCORED), "y", "p", ["model"], "macro")


BINARY = """select lang, cast(quality as varchar(3)) as y, case when n_chars > 800 or source = 'web' then '1' else '0' end as p
    from labels join documents on labels.doc_id = documents.doc_id"""


@query(
    "classification_metrics_binary",
    f"with s as ({BINARY}), {metric_sql('lang', averaging='binary')} select * from m",
)
def classification_metrics_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.classification_metrics(derived(spark, sf_dir, BINARY), "y", "p", ["lang"], "binary")


@query(
    "confusion_matrix",
    f"""with s as ({SCORED}), c as (select distinct model, y as c from s union select distinct model, p from s)
    select a.model, a.c as label, b.c as prediction,
        (select count(*) from s where s.model = a.model and s.y = a.c and s.p = b.c) as n
    from c a join c b on a.model = b.model""",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion_matrix(derived(spark, sf_dir, SCORED), "y", "p", ["model"])


REG_SQL = """
    m as (select {by}, round_even(avg(abs(value - estimate)), 4) as mae, round_even(avg((value - estimate) ** 2), 4) as mse,
        round_even(sqrt(avg((value - estimate) ** 2)), 4) as rmse,
        round_even(1 - avg((value - estimate) ** 2) / var_pop(value), 4) as r2, count(*) as n_samples from s group by {by})"""


@query(
    "regression_metrics",
    f"with s as ({SCORED}), {REG_SQL.format(by='model, split')} select * from m",
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.regression_metrics(derived(spark, sf_dir, SCORED), "value", "estimate", ["model", "split"])


@query(
    "evaluate_splits",
    f"""with s as ({SCORED}), {metric_sql('model, split')},
    l as (select model, split, metric, value from m unpivot (value for metric in (accuracy, "precision", recall, f1_score)))
    select model, metric, max(value) filter (split = 'val') as val, max(value) filter (split = 'test') as test
    from l group by model, metric""",
)
def evaluate_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.evaluate_splits(derived(spark, sf_dir, SCORED), "y", "p", "split", ["model"])


@query(
    "holdout_eval",
    f"""with s0 as ({SCORED}), s as (select * from s0 where y in (select distinct y from s0 where split = 'val' and y <> '3-MEDIUM')
        and split = 'test'), {metric_sql('model')},
    d as (select model, y, count(*) as k from s group by all),
    j as (select model, '{{' || string_agg('"' || y || '":' || k, ',' order by y) || '}}' as class_distribution from d group by model)
    select m.*, class_distribution from m join j using (model)""",
)
def holdout_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = derived(spark, sf_dir, SCORED)
    known = scored.where("split = 'val' and y <> '3-MEDIUM'").select("y").distinct()
    return mt.holdout_metrics(scored.where("split = 'test'"), known, "y", "p", ["model"])


@query(
    "before_after_delta",
    f"""with s as ({SCORED}), {metric_sql('model, split')},
    l as (select model, split, metric, value from m unpivot (value for metric in (accuracy, "precision", recall, f1_score))),
    d as (select b.model, b.metric, b.value as baseline, a.value as after, round_even(a.value - b.value, 4) + 0.0 as delta
        from l b join l a on a.model = b.model and a.metric = b.metric where b.split = 'val' and a.split = 'test')
    select d.*, max(case when metric = 'accuracy' then delta end) over (partition by model) > 0 as improved from d""",
)
def before_after_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = mt.classification_metrics(derived(spark, sf_dir, SCORED), "y", "p", ["model", "split"])
    long = mt.long_metrics(wide, ["model", "split"], mt.CLASSIFICATION)
    before, after = long.where("split = 'val'").drop("split"), long.where("split = 'test'").drop("split")
    deltas = mt.before_after(before, after, ["model"])
    out = deltas.join(mt.improved(deltas, ["model"]), "model")
    return out.withColumn("delta", F.col("delta") + F.lit(0.0))


SCENARIOS = """select month(o_orderdate) as scenario, o_orderstatus as model, o_orderpriority as y,
    case when o_orderkey % (2 + month(o_orderdate)) = 0 then '1-URGENT' else o_orderpriority end as p from orders"""


@query(
    "scenario_sensitivity",
    f"""with all_rows as ({SCENARIOS}),
    s as (select * from all_rows), {metric_sql('model, scenario')},
    bs as (select model, y, p from all_rows),
    {metric_sql('model', 'bs').replace('sides', 'bsides').replace('cls', 'bcls').replace('pr as', 'bpr as').replace('from pr', 'from bpr').replace('m as', 'bm as')},
    j as (select m.*, round_even(m.accuracy - bm.accuracy, 4) + 0.0 as delta_accuracy, round_even(m."precision" - bm."precision", 4) + 0.0 as delta_precision,
        round_even(m.recall - bm.recall, 4) + 0.0 as delta_recall, round_even(m.f1_score - bm.f1_score, 4) + 0.0 as delta_f1_score
        from m join bm using (model)),
    r as (select *, case when abs(delta_accuracy) >= 0.15 then 'high' when abs(delta_accuracy) >= 0.05 then 'medium' else 'low' end as sensitivity,
        row_number() over (partition by model order by abs(delta_accuracy) desc, scenario) as place from j)
    select r.* from r""",
)
def scenario_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, SCENARIOS)
    scenarios = mt.classification_metrics(rows, "y", "p", ["model", "scenario"])
    baseline = mt.classification_metrics(rows, "y", "p", ["model"])
    out = mt.sensitivity(scenarios, baseline, ["model"])
    deltas = {f"delta_{m}": F.col(f"delta_{m}") + F.lit(0.0) for m in mt.CLASSIFICATION}
    return out.withColumns({**deltas, "scenario": F.col("scenario").cast("bigint"), "place": F.col("place").cast("bigint")})


@query(
    "analysis_quality_gate",
    """with g as (select o_custkey as model, avg(case when o_orderstatus <> 'F' then 1.0 else 0.0 end) as a from orders group by o_custkey)
    select model, round(a, 6) as accuracy, a > 0.6 as analyse from g""",
)
def analysis_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("model")).agg(
        F.avg((F.col("o_orderstatus") != "F").cast("double")).alias("value")
    )
    out = mt.analysis_gate(rates.withColumn("metric", F.lit("accuracy")), ["model"])
    return out.withColumn("accuracy", r6("accuracy"))
