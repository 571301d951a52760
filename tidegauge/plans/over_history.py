"""Named queries: drift history per model, read off the event stream (a user stands for a model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import history as hs
from tidegauge.plans.catalog import derived, query

RESULTS = """
    select event_id, user_id as model, ts as generated_at, case when event_type = 'view' then 'image' else 'tabular' end as drift_type,
        case when event_type = 'click' then cast(0 as double) when event_type = 'view' then null else value / 100 end as drift_score,
        value / 120 as drift_share,
        case when value > 60 then 'high' when value > 30 then 'medium' when value > 10 then 'low' else null end as severity,
        case when event_type = 'signup' then null else value > 25 end as detected,
        case when event_type = 'view' then event_id % 90 end as batch_size, event_id % 70 as row_count
    from events"""
SEV = "case severity when 'high' then 2 when 'medium' then 1 else 0 end"


@query(
    "history_index",
    f"""with r as ({RESULTS}) select generated_at as "timestamp", null::varchar as dataset_version_id, drift_type,
        severity as overall_severity, drift_share, null::bigint as drifted_feature_count, drift_score,
        'records/' || event_id || '.json' as json_path, null::varchar as mlflow_run_id from r""",
)
def history_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, RESULTS)
    nested = rows.withColumn("overall", F.struct("severity", "drift_share", "drift_score"))
    path = F.concat(F.lit("records/"), F.col("event_id").cast("string"), F.lit(".json"))
    return hs.history_index(nested, path)


HISTORY = "select user_id as model, event_id as position, concat('r', cast(event_id as varchar(20))) as json_path from events where event_type = 'error'"
RECORDS = """select user_id as model, concat('r', cast(event_id as varchar(20))) as path, ts as modified_at, value > 20 as readable
    from events where event_type <> 'click'"""


@query(
    "latest_drift",
    f"""with h as ({HISTORY}), r as (select * from ({RECORDS}) where readable),
    l as (select h.model, max_by(h.json_path, h.position) as line_path from h join r on r.model = h.model and r.path = h.json_path group by h.model),
    n as (select model, max_by(path, (modified_at, path)) as path from r group by model)
    select n.model, coalesce(line_path, n.path) as path, case when line_path is not null then 'history' else 'snapshot' end as source
    from n left join l using (model)""",
)
def latest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.latest_drift(derived(spark, sf_dir, HISTORY), derived(spark, sf_dir, RECORDS))


@query(
    "summary_rows",
    f"""with r as ({RESULTS}) select event_id, model, generated_at, drift_type, coalesce(nullif(drift_score, 0), drift_share) as score,
        coalesce(batch_size, row_count) as size, case when detected then 'YES' when not detected then 'NO' else '?' end as detected_text,
        upper(coalesce(severity, '?')) as severity_text from r""",
)
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hs.summary_rows(derived(spark, sf_dir, RESULTS))
    return out.select("event_id", "model", "generated_at", "drift_type", "score", "size", "detected_text", "severity_text")


@query(
    "last_n_runs",
    f"""with r as ({RESULTS}) select event_id, model, generated_at from (select *, row_number() over (
        partition by model order by generated_at desc, event_id desc) as rn from r) where rn <= 3""",
)
def last_n_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.last_runs(derived(spark, sf_dir, RESULTS), ["model"], "generated_at", 3, "event_id").select(
        "event_id", "model", "generated_at"
    )


@query(
    "severity_trend",
    f"""with r as ({RESULTS}), l as (select * from (select *, {SEV} as rank, row_number() over (
        partition by model order by generated_at desc, event_id desc) as rn from r) where rn <= 5),
    e as (select model, count(*) as runs, max_by(rank, rn) as first, min_by(rank, rn) as last from l group by model)
    select model, runs, case when runs < 2 then 'insufficient data' when last > first then 'WORSENING' when last < first then 'IMPROVING'
        else 'STABLE' end as trend from e""",
)
def severity_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.severity_trend(derived(spark, sf_dir, RESULTS), ["model"], "generated_at", "event_id")


@query(
    "summary_counts",
    f"""with r as ({RESULTS}) select model, count(*) as runs, count(*) filter (detected) as drifted,
        (100 * count(*) filter (detected) // count(*))::bigint as percent, count(*) filter (severity = 'high') as high,
        count(*) filter (severity = 'medium') as medium, count(*) filter (severity is null or severity = 'low') as low from r group by model""",
)
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.summary_counts(derived(spark, sf_dir, RESULTS), ["model"])


MANIFESTS = """select c_nationkey as dataset, c_custkey as attempt_id, c_acctbal as added, c_acctbal > 0 as readable from customer"""


@query(
    "attempt_list",
    f"""with m as (select * from ({MANIFESTS}) where readable)
    select dataset, attempt_id, added, attempt_id = max(attempt_id) over (partition by dataset) as is_latest from m""",
)
def attempt_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.attempts(derived(spark, sf_dir, MANIFESTS), ["dataset"])
