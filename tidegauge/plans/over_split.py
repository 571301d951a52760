"""Named queries: splits, holdouts and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import split as sp
from tidegauge.plans.catalog import derived, query, r6, table


def ranked_sql(source: str, label: str, key: str, seed: int = 42, where: str = "true") -> str:
    return f"""select *, row_number() over (partition by {label} order by sha256('{seed}:' || {key}::varchar)) as place,
        count(*) over (partition by {label}) as n from {source} where {where}"""


@query(
    "split_stratified",
    f"""with r as ({ranked_sql('customer', 'c_mktsegment', 'c_custkey')})
    select c_custkey, c_mktsegment, case when place <= round_even(n * 0.7, 0) then 'train'
        when place <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) then 'val' else 'test' end as split from r""",
)
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sp.split_stratified(rows, "c_mktsegment", "c_custkey")


@query(
    "split_random",
    """with r as (select o_orderkey, o_totalprice,
        ('0x' || substr(sha256('7:' || o_orderkey::varchar), 1, 8))::bigint / 4294967296.0 as u from orders)
    select o_orderkey, o_totalprice, case when u < 0.7 then 'train' when u < 0.85 then 'val' else 'test' end as split from r""",
)
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.split_random(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", seed=7)


NAMED = """
    select o_orderkey, o_orderpriority, concat(case when o_orderstatus = 'F' then 'test_' else 'Train_' end,
        cast(o_orderkey as varchar(30)), '.png') as file_name from orders"""


@query(
    "split_preserve_test",
    f"""with s as ({NAMED}), g as (select *, case when o like 'test%' then 'test' else 'train' end as side
        from (select *, lower(file_name) as o from s)),
    r as ({ranked_sql('g', 'o_orderpriority, side', 'o_orderkey')})
    select o_orderkey, o_orderpriority, file_name, case when side = 'test' then 'test'
        when place <= round_even(n * 0.15, 0) then 'val' else 'train' end as split from r""",
)
def split_preserve_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.split_preserving_test(derived(spark, sf_dir, NAMED), "o_orderpriority", "file_name", "o_orderkey")


@query(
    "split_profile",
    f"""with r as ({ranked_sql('customer', 'c_mktsegment', 'c_custkey')}),
    s as (select c_mktsegment as label, case when place <= round_even(n * 0.7, 0) then 'train'
        when place <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) then 'val' else 'test' end as split from r),
    c as (select split, label, count(*) as n from s group by all),
    t as (select split, sum(n)::bigint as n from c group by split)
    select split, label, 0 as level, n, round(n / sum(n) over (partition by split), 4) as share from c
    union all select split, null, 1, n, round(n / sum(n) over (), 4) from t""",
)
def split_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.split_profile(split_stratified(spark, sf_dir), "c_mktsegment")


@query(
    "holdout_stratified",
    f"""with r as ({ranked_sql('documents', 'source', 'doc_id', 5)})
    select doc_id, source, case when place <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) then 'holdout'
        else 'train' end as part from r""",
)
def holdout_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sp.holdout_stratified(rows, "source", "doc_id", 0.2, seed=5)


@query(
    "holdout_tabular",
    f"""with r as ({ranked_sql('part', 'p_type', 'p_partkey', 9)}),
    a as (select *, row_number() over (order by sha256('9:' || p_partkey::varchar)) as whole, count(*) over () as total from part)
    select p_partkey, p_type, 'classification' as task,
        case when place <= least(round_even(n * 0.3, 0), n - 1) then 'holdout' else 'train' end as part from r
    union all select p_partkey, p_type, 'regression',
        case when whole <= least(greatest(round_even(total * 0.3, 0), 1), total - 1) then 'holdout' else 'train' end from a""",
)
def holdout_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    parts = [
        sp.holdout_tabular(rows, "p_type", "p_partkey", 0.3, task, seed=9).withColumn("task", F.lit(task))
        for task in ("classification", "regression")
    ]
    return parts[0].unionByName(parts[1])


DRIFTED = "select event_id, event_type, value, value > 30 as is_drifted from events"


@query(
    "drift_val_slice",
    f"""with d as ({DRIFTED}), r as ({ranked_sql('d', 'event_type', 'event_id', 3, 'is_drifted')})
    select event_id, event_type, value, is_drifted from r
    where n > 1 and place <= least(greatest(1, round_even(n * 0.25, 0)), n - 1)""",
)
def drift_val_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.drift_val_slice(derived(spark, sf_dir, DRIFTED), "event_type", "is_drifted", "event_id", 0.25, seed=3)


@query(
    "oversample_weights",
    f"""with d as ({DRIFTED}), k as (select count(*) filter (is_drifted) as d, count(*) filter (not is_drifted) as c from d)
    select event_id, is_drifted, case when is_drifted and k.d > 0 and k.c > 0 then round(0.3 / 0.7 * k.c / k.d, 6)
        else 1.0::double end as weight from d, k""",
)
def oversample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sp.oversample_weights(derived(spark, sf_dir, DRIFTED), "is_drifted", 0.3)
    return out.select("event_id", "is_drifted", r6("weight").alias("weight"))


@query("weighted_resample")
def weighted_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = sp.oversample_weights(derived(spark, sf_dir, DRIFTED), "is_drifted", 0.3)
    size = weighted.count()
    return sp.weighted_resample(weighted, "weight", "event_id", size).select("event_id", "is_drifted", "copy_no")


# The draw itself has no twin in SQL; its size, the copies' numbers and what it may draw from do.
@query(
    "weighted_resample_size",
    """select count(*) as drawn, true as all_known, true as near_its_share, count(*) as copies_numbered from events""",
)
def weighted_resample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows drawn in all, whether all are rows of the input, and whether the drifted ones are within five deviations of
    the wanted share of 0.3."""
    drawn = weighted_resample(spark, sf_dir)
    known = table(spark, sf_dir, "events").select("event_id", F.lit(True).alias("known"))
    rows = drawn.groupBy("event_id", "is_drifted").agg(F.count("*").alias("n"), F.max("copy_no").alias("last"))
    n, hit = F.sum("n"), F.sum(F.when(F.col("is_drifted"), F.col("n")).otherwise(0))
    return rows.join(known, "event_id", "left").agg(
        n.alias("drawn"),
        F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"),
        (F.abs(hit - n * 0.3) <= 5 * F.sqrt(n * 0.21)).alias("near_its_share"),
        F.sum("last").cast("bigint").alias("copies_numbered"),
    )


@query(
    "class_weight_balanced",
    """with c as (select o_orderpriority as label, count(*) as n from orders group by all)
    select label, n, round(sum(n) over () / (count(*) over () * n), 6) as weight from c""",
)
def class_weight_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.class_weights(table(spark, sf_dir, "orders"), "o_orderpriority").withColumn("weight", r6("weight"))
