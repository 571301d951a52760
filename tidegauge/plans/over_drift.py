"""Named queries of the drift family.

Reference: lineitem shipped before 1999. Batches: the later months, with quantities raised and one return
flag rewritten in the first months of a year, so that severities of every kind occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import DriftConfig
from tidegauge.functions.severity import feature_severity, overall_severity, raises_alert, trips_gate
from tidegauge.operators import two_sample as ts
from tidegauge.operators.drift_report import (
    alignment_table,
    batch_sizes,
    dataset_table,
    feature_table,
    large_enough,
    scored_grid,
    small_sample,
    with_alerts,
)
from tidegauge.plans.catalog import derived, query, r6, table
from tidegauge.plans.monitor import monitor, monitor_features

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linestatus"]

REF_SQL = """
    select l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
    from lineitem where l_shipdate < timestamp '1999-01-01 00:00:00'"""
CUR_SQL = """
    select substr(cast(l_shipdate as varchar(30)), 1, 7) as batch,
           case when month(l_shipdate) < 4 then l_quantity * 1.2 else l_quantity end as l_quantity,
           case when month(l_shipdate) = 2 then l_extendedprice * 1.05 else l_extendedprice end as l_extendedprice,
           l_discount, case when month(l_shipdate) = 2 then l_tax + 0.01 else l_tax end as l_tax,
           case when month(l_shipdate) = 3 and l_returnflag = 'A' and l_linenumber = 1 then 'X'
                else l_returnflag end as l_returnflag,
           l_linestatus
    from lineitem where l_shipdate >= timestamp '1999-01-01 00:00:00'"""


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derived(spark, sf_dir, REF_SQL), derived(spark, sf_dir, CUR_SQL)


# --- SQL building blocks --------------------------------------------------------------------------------

SIDES = f"with ref as ({REF_SQL}), cur as ({CUR_SQL})"
P_KS = """case when z2 < 0.04 then 1.0 else least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
    lambda k: (case when k % 2 = 1 then 1.0 else -1.0 end) * exp(-2.0 * k * k * z2))))) end"""
# Lower incomplete gamma by its series; far tails are 0 to every digit shown.
P_CHI = """case when df <= 0 then 1.0 when statistic > 300 + 4 * df then 0.0 else
    1 - list_sum(list_transform(range(0, 1500), lambda k: case when statistic <= 0 then 0.0 else
    exp((df / 2.0 + k) * ln(statistic / 2.0) - statistic / 2.0 - lgamma(df / 2.0 + k + 1)) end)) end"""


def long_sql(columns: list[str]) -> str:
    cols = ", ".join(columns)
    return f"""
    rl as (select feature, value from ref unpivot (value for feature in ({cols}))),
    cl as (select batch, feature, value from cur unpivot (value for feature in ({cols}))),
    rn as (select feature, count(*) as n, count(distinct value) as kinds from rl group by all),
    cm as (select feature, batch, count(*) as m from cl group by all)"""


# every (feature, batch) against every value of either side, with both cumulative shares
ECDF = f"""
    rv as (select feature, value, count(*) as c from rl group by all),
    cv as (select feature, batch, value, count(*) as c from cl group by all),
    merged as (select feature, batch, value, sum(a) as a, sum(b) as b from (
        select cm.feature, cm.batch, rv.value, rv.c as a, 0 as b from cm join rv using (feature)
        union all select feature, batch, value, 0, c from cv) group by all),
    ecdf as (select feature, batch, value, n, m, sum(a) over w / n as f, sum(b) over w / m as g,
        lead(value) over w - value as step
        from merged join cm using (feature, batch) join rn using (feature)
        window w as (partition by feature, batch order by value)),
    kst as (select feature, batch, n, m, max(abs(f - g)) as d, d * d * n * m / (n + m) as z2
        from ecdf group by feature, batch, n, m),
    ks as (select feature, batch, n, m, d as statistic, {P_KS} as p_value from kst)"""
WASS = """
    mo as (select feature, stddev_pop(value) as sd from rl group by all),
    ws as (select feature, batch, sum(abs(f - g) * step) as statistic,
        statistic / case when sd > 0 then sd else 1 end as scaled
        from ecdf join mo using (feature) group by feature, batch, sd)"""
def chi_sql(p: str = "") -> str:
    return f"""
    {p}rv as (select feature, value, count(*) as c from {p}rl group by all),
    {p}cv as (select feature, batch, value, count(*) as c from {p}cl group by all),
    {p}cells as (select feature, batch, value from {p}cm join {p}rv using (feature)
        union select feature, batch, value from {p}cv),
    {p}ex as (select k.feature, k.batch, coalesce(c.c, 0) as o, coalesce(r.c / n * m, 0.5) as e
        from {p}cells k join {p}rn a on a.feature = k.feature
        join {p}cm b on b.feature = k.feature and b.batch = k.batch
        left join {p}rv r on r.feature = k.feature and r.value = k.value
        left join {p}cv c on c.feature = k.feature and c.batch = k.batch and c.value = k.value),
    {p}chst as (select feature, batch, case when count(*) > 1 then sum((o - e) * (o - e) / e) else 0 end as statistic,
        count(*) - 1 as df from {p}ex group by all),
    chi as (select feature, batch, statistic, df, {P_CHI} as p_value from {p}chst)"""


SHARES = """
    share as (select cells.feature, cells.batch, greatest(coalesce(rv.c, 0) / n, 1e-4) as p,
        greatest(coalesce(cv.c, 0) / m, 1e-4) as q
        from cells join rn on rn.feature = cells.feature join cm on cm.feature = cells.feature and cm.batch = cells.batch
        left join rv on rv.feature = cells.feature and rv.value = cells.value
        left join cv on cv.feature = cells.feature and cv.batch = cells.batch and cv.value = cells.value),
    dist as (select feature, batch, sum((p - q) * ln(p / q)) as psi,
        sqrt(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2) as jensenshannon from share group by all)"""
CELLS = """
    rv as (select feature, value, count(*) as c from rl group by all),
    cv as (select feature, batch, value, count(*) as c from cl group by all),
    cells as (select feature, batch, value from cm join rv using (feature)
        union select feature, batch, value from cv)"""
BINNED = f"""
    rl0 as (select feature, value from ref unpivot (value for feature in ({', '.join(NUM)}))),
    cl0 as (select batch, feature, value from cur unpivot (value for feature in ({', '.join(NUM)}))),
    span as (select feature, min(value) as lo, max(value) as hi from rl0 group by all),
    rl as (select feature, greatest(0, least(9, floor((value - lo) / (hi - lo) * 10)))::int::varchar as value
        from rl0 join span using (feature)),
    cl as (select batch, feature, greatest(0, least(9, floor((value - lo) / (hi - lo) * 10)))::int::varchar as value
        from cl0 join span using (feature)),
    rn as (select feature, count(*) as n from rl group by all),
    cm as (select feature, batch, count(*) as m from cl group by all)"""


# --- single tests ---------------------------------------------------------------------------------------


@query(
    "drift_ks",
    f"""{SIDES}, {long_sql(NUM)}, {ECDF}
    select feature, batch, round(statistic, 6) as statistic, round(p_value, 6) as p_value, n::bigint as n, m::bigint as m
    from ks""",
)
def drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = both_sides(spark, sf_dir)
    out = ts.ks(ts.samples(ref, cur, NUM, "batch"))
    return out.select("feature", "batch", r6("statistic").alias("statistic"), r6("p_value").alias("p_value"), "n", "m")


@query(
    "drift_wasserstein",
    f"""{SIDES}, {long_sql(NUM)}, {ECDF}, {WASS}
    select feature, batch, round(statistic, 4) as statistic, round(scaled, 6) as scaled from ws""",
)
def drift_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = both_sides(spark, sf_dir)
    out = ts.wasserstein(ts.samples(ref, cur, NUM, "batch"))
    return out.select("feature", "batch", r6("statistic", 4).alias("statistic"), r6("scaled").alias("scaled"))


@query(
    "drift_chisquare",
    f"""{SIDES}, {long_sql(CAT)}, {chi_sql()}
    select feature, batch, round(statistic, 6) as statistic, df::bigint as df, round(p_value, 6) + 0.0 as p_value from chi""",
)
def drift_chisquare(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = both_sides(spark, sf_dir)
    out = ts.chi_square(ts.value_counts(ref, cur, CAT, "batch", "string"))
    return out.select(
        "feature", "batch", r6("statistic").alias("statistic"), "df", r6("p_value").alias("p_value")
    )


@query(
    "drift_psi",
    f"""{SIDES}, {BINNED}, {CELLS}, {SHARES}
    select feature, batch, round(psi, 6) as psi from dist""",
)
def drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = both_sides(spark, sf_dir)
    return ts.share_distances(ts.bin_counts(ref, cur, NUM, "batch", 10), few=True).select("feature", "batch", r6("psi").alias("psi"))


@query(
    "drift_jensenshannon",
    f"""{SIDES}, {long_sql(CAT)}, {CELLS}, {SHARES}
    select feature, batch, round(jensenshannon, 6) as jensenshannon from dist""",
)
def drift_jensenshannon(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = both_sides(spark, sf_dir)
    out = ts.share_distances(ts.value_counts(ref, cur, CAT, "batch", "string"))
    return out.select("feature", "batch", r6("jensenshannon").alias("jensenshannon"))


# --- graded tables --------------------------------------------------------------------------------------

TABLE = f"""{SIDES}, {long_sql(NUM)}, {ECDF},
    crl as (select feature, value from ref unpivot (value for feature in ({', '.join(CAT)}))),
    ccl as (select batch, feature, value from cur unpivot (value for feature in ({', '.join(CAT)}))),
    crn as (select feature, count(*) as n from crl group by all),
    ccm as (select feature, batch, count(*) as m from ccl group by all),
    {chi_sql("c")},
    feat as (
        select batch, feature, 'num' as column_type, 'ks' as stattest_name, p_value as drift_score from ks
        union all
        select batch, feature, 'cat', 'chisquare', p_value from chi),
    graded as (select *, 0.05::double as stattest_threshold, drift_score < 0.05 as drift_detected,
        case when drift_score >= 0.05 then 'low' when drift_score < 0.001 then 'high'
             when drift_score < 0.01 then 'medium' else 'low' end as severity from feat),
    overall as (select batch, count(*) filter (drift_detected) as drifted_feature_count, count(*) as total_feature_count,
        drifted_feature_count / total_feature_count as drift_share,
        case when drift_share <= 0.25 then 'low' when drift_share <= 0.5 then 'medium' else 'high' end as severity
        from graded group by batch)"""


@query(
    "drift_feature_table",
    f"""{TABLE} select batch, feature, column_type, stattest_name, stattest_threshold,
    round(drift_score, 6) + 0.0 as drift_score, drift_detected, severity from graded""",
)
def drift_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = both_sides(spark, sf_dir)
    return feature_table(ref, cur, NUM + CAT, "batch").withColumn("drift_score", r6("drift_score"))


@query(
    "drift_dataset",
    f"""{TABLE} select batch, drifted_feature_count, total_feature_count, round(drift_share, 6) as drift_share,
    drift_share >= 0.5 as dataset_drift_detected, severity from overall""",
)
def drift_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = both_sides(spark, sf_dir)
    out = dataset_table(feature_table(ref, cur, NUM + CAT, "batch"))
    return out.withColumn("drift_share", r6("drift_share"))


SCORES_SQL = """
    select o_orderkey, o_orderpriority, o_totalprice / 1000000.0 as p, o_totalprice / 600000.0 as distance
    from orders"""


@query(
    "drift_feature_severity",
    f"""with s as ({SCORES_SQL})
    select o_orderkey,
        case when p >= 0.05 then 'low' when p < 0.001 then 'high' when p < 0.01 then 'medium' else 'low' end as by_p_value,
        case when distance < 0.1 then 'low' when distance >= 0.25 then 'high' else 'medium' end as by_distance
    from s""",
)
def drift_feature_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, SCORES_SQL)
    p, d = F.col("p"), F.col("distance")
    return s.select(
        "o_orderkey",
        feature_severity(p, p < 0.05, F.lit("ks")).alias("by_p_value"),
        feature_severity(d, d >= 0.1, F.lit("psi")).alias("by_distance"),
    )


SHARE_SQL = """
    select o_custkey, sum(case when o_orderstatus = 'F' then 1 else 0 end) as drifted, count(*) as total
    from orders group by o_custkey"""


@query(
    "drift_overall_severity",
    f"""with s as ({SHARE_SQL})
    select o_custkey, case when drifted / total <= 0.25 then 'low' when drifted / total <= 0.5 then 'medium'
        else 'high' end as severity from s""",
)
def drift_overall_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, SHARE_SQL)
    return s.select("o_custkey", overall_severity(F.col("drifted") / F.col("total")).alias("severity"))


@query(
    "drift_small_sample",
    """with c as (select user_id as batch, count(*) as row_count from events group by all),
    r as (select count(*) as n from events)
    select batch::varchar as batch, row_count, row_count < 30 or (select n from r) < 30 as small_sample from c""",
)
def drift_small_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ref_rows = events.agg(F.count("*")).scalar()
    sizes = batch_sizes(events, "user_id").withColumn("n_ref", ref_rows)
    flags = small_sample(F.col("n_ref"), F.col("row_count"))
    return sizes.select("batch", "row_count", F.array_contains(flags, "small_sample").alias("small_sample"))


@query(
    "drift_min_batch",
    """with c as (select user_id, count(*) as n from events group by all having count(*) >= 10)
    select event_id, user_id, value from events where user_id in (select user_id from c)""",
)
def drift_min_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return large_enough(events, "user_id", DriftConfig().min_batch_size).select("event_id", "user_id", "value")


GATE_SQL = """
    select event_id, case event_type when 'click' then 'low' when 'view' then 'medium' when 'error' then 'high'
        when 'purchase' then 'high' else event_type end as severity from events"""


@query(
    "drift_alert_gate",
    f"""with s as ({GATE_SQL})
    select event_id, severity, severity in ('medium', 'high') as alert, severity = 'high' as gate_high,
        severity in ('medium', 'high') as gate_medium, false as gate_never, false as gate_interactive from s""",
)
def drift_alert_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, GATE_SQL)
    sev = F.col("severity")
    return s.select(
        "event_id",
        "severity",
        raises_alert(sev, "medium").alias("alert"),
        trips_gate(sev, "high").alias("gate_high"),
        trips_gate(sev, "medium").alias("gate_medium"),
        trips_gate(sev, "never").alias("gate_never"),
        trips_gate(sev, "high", interactive=True).alias("gate_interactive"),
    )


@query(
    "drift_alignment",
    """select * from (values ('error', 'type_mismatch', 'l_tax', 'feature l_tax is numeric in the reference, categorical in the batch'),
        ('warning', 'extra_column', 'note', 'column note is ignored')) t(level, "check", feature, message)
    union all select 'warning', 'empty_batch', null, 'the batch has no rows' from lineitem
        where l_shipdate >= timestamp '1999-01-01 00:00:00' having count(*) = 0""",
)
def drift_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = both_sides(spark, sf_dir)
    retyped = cur.withColumn("l_tax", F.col("l_tax").cast("string")).withColumn("note", F.lit("new"))
    return alignment_table(ref, retyped, NUM + CAT, ("batch",))


@query(
    "monitor_batch",
    f"""{TABLE} select g.batch, g.feature, g.column_type, g.stattest_name, g.stattest_threshold,
    round(g.drift_score, 6) + 0.0 as drift_score, g.drift_detected, g.severity,
    round(o.drift_share, 6) as drift_share, o.drift_share >= 0.5 as dataset_drift_detected, o.severity as overall_severity
    from graded g join overall o using (batch)
    where batch in (select batch from cur group by batch having count(*) >= 10)""",
)
def monitor_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = both_sides(spark, sf_dir)
    out = monitor_features(ref, cur, NUM + CAT, "batch")
    return out.withColumns({"drift_score": r6("drift_score"), "drift_share": r6("drift_share")})


def drift_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = both_sides(spark, sf_dir)
    return monitor(ref, cur, NUM + CAT, "batch", generated_at=F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query(
    "drift_result",
    f"""{TABLE}, sizes as (select batch, count(*) as rows_in from cur group by batch)
    select o.batch, '1.1.0' as schema_version, 'ks/chisquare' as method, round(o.drift_share, 6) as drift_share,
        o.drifted_feature_count, o.total_feature_count, o.severity, rows_in as batch_rows, (select count(*) from ref) as reference_rows,
        count(*) filter (g.severity = 'low') as n_low, count(*) filter (g.severity = 'medium') as n_medium,
        count(*) filter (g.severity = 'high') as n_high, string_agg(g.feature || ':' || g.severity, ',' order by g.feature) as features,
        rows_in < 30 as small_sample, o.severity in ('medium', 'high') as alert, o.severity = 'high' as gate
    from overall o join graded g using (batch) join sizes using (batch) where rows_in >= 10
    group by o.batch, o.drift_share, o.drifted_feature_count, o.total_feature_count, o.severity, rows_in""",
)
def drift_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested records, flattened for comparison."""
    listed = F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["severity"]))
    return drift_records(spark, sf_dir).select(
        "batch",
        "schema_version",
        "method",
        r6("overall.drift_share").alias("drift_share"),
        "overall.drifted_feature_count",
        "overall.total_feature_count",
        "overall.severity",
        F.col("current_dataset.row_count").alias("batch_rows"),
        F.col("reference_dataset.row_count").alias("reference_rows"),
        *[F.col(f"severity_counts.{s}").alias(f"n_{s}") for s in ("low", "medium", "high")],
        F.array_join(F.array_sort(listed), ",").alias("features"),
        F.array_contains("warnings", "small_sample").alias("small_sample"),
        "alert",
        "gate",
    )


# Infinities in one batch and in one feature of the reference; they count as missing and touch nothing else.
INF = "cast('infinity' as double)"
INF_REF = REF_SQL.replace("l_discount, l_tax", f"l_discount, case when l_orderkey % 101 = 0 then -{INF} else l_tax end as l_tax")
INF_CUR = CUR_SQL.replace(
    "l_discount, case", f"case when month(l_shipdate) = 5 and l_linenumber = 1 then {INF} else l_discount end as l_discount, case"
)
INF_SIDES = f"with ref as ({INF_REF}), cur as ({INF_CUR})"
FINITE_LONG = long_sql(NUM).replace(f"for feature in ({', '.join(NUM)}))", f"for feature in ({', '.join(NUM)})) where isfinite(value)")


@query(
    "drift_non_finite",
    f"""{INF_SIDES}, {FINITE_LONG}, {ECDF}, {WASS},
    flag as (select batch, bool_or(isinf(l_discount)) as holds from cur group by batch)
    select feature, batch, round(scaled, 6) as scaled, case feature when 'l_tax' then true when 'l_discount' then holds else false end as is_infinite
    from ws join flag using (batch)""",
)
def drift_non_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = derived(spark, sf_dir, INF_REF), derived(spark, sf_dir, INF_CUR)
    out = scored_grid(ref, cur, NUM, "batch", DriftConfig(numeric_test="wasserstein", numeric_threshold=0.1))
    return out.select("feature", "batch", r6("drift_score").alias("scaled"), "is_infinite")


# Every user is a batch: as many batches as rows allow, most of them small.
USER_REF = "select value, event_type from events where ts < timestamp '2024-01-08 00:00:00'"
USER_CUR = """select user_id as batch, case when user_id % 7 = 0 then value * 1.3 else value end as value,
    case when user_id % 11 = 0 and event_type = 'click' then 'tap' else event_type end as event_type
    from events where ts >= timestamp '2024-01-08 00:00:00'"""


@query(
    "monitor_many_batches",
    f"""with ref as (select value as v from ({USER_REF})), cur as (select batch, value as v from ({USER_CUR})),
    {long_sql(["value"]).replace("feature in (value)", "feature in (v)")}, {ECDF},
    crl as (select 'event_type' as feature, event_type as value from ({USER_REF})),
    ccl as (select batch, 'event_type' as feature, event_type as value from ({USER_CUR})),
    crn as (select feature, count(*) as n from crl group by all),
    ccm as (select feature, batch, count(*) as m from ccl group by all),
    {chi_sql("c")},
    feat as (select batch, 'value' as feature, p_value as drift_score from ks union all select batch, feature, p_value from chi),
    counted as (select batch, count(*) as row_count from cur group by all having count(*) >= 10)
    select batch::varchar as batch, feature, row_count, round(drift_score, 6) + 0.0 as drift_score, drift_score < 0.05 as drift_detected
    from feat join counted using (batch)""",
)
def monitor_many_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id`` names the batch."""
    ref, cur = derived(spark, sf_dir, USER_REF), derived(spark, sf_dir, USER_CUR)
    out = scored_grid(ref, cur, ["value", "event_type"], "batch", DriftConfig(), DriftConfig().min_batch_size)
    return out.select("batch", "feature", "row_count", r6("drift_score").alias("drift_score"), "drift_detected")


EVENT_REF = "select value, event_type from events where ts < timestamp '2024-01-08 00:00:00'"
EVENT_CUR = """select cast(cast(ts as date) as varchar(10)) as batch, value * 1.1 as value, event_type
    from events where ts >= timestamp '2024-01-08 00:00:00'"""
EVENT_LONG = long_sql(["value"]).replace("feature in (value)", "feature in (v)")


@query(
    "windowed_drift",
    f"""with ref as (select value as v from ({EVENT_REF})), cur as (select batch, value as v from ({EVENT_CUR})),
    {EVENT_LONG}, {ECDF}
    select batch, 'value' as feature, round(statistic, 6) as statistic, round(p_value, 6) as p_value, m::bigint as m from ks""",
)
def windowed_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.streaming.windows import windowed_ks

    events = table(spark, sf_dir, "events")
    early = events.where("ts < timestamp '2024-01-08 00:00:00'")
    late = events.where("ts >= timestamp '2024-01-08 00:00:00'").withColumn("value", F.col("value") * 1.1)
    out = windowed_ks(early, late, ["value"], "ts", "1 day")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("batch"),
        "feature",
        r6("statistic").alias("statistic"),
        r6("p_value").alias("p_value"),
        "m",
    )
