"""Named queries of the stream and of the stored history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import DriftConfig
from tidegauge.plans.catalog import derived, query, r6, table
from tidegauge.plans.over_drift import CELLS, SHARES, chi_sql
from tidegauge.session import checkpointed, plan_bytes, scratch_folder
from tidegauge.sources import history as hist
from tidegauge.streaming.arrivals import monitor_arrivals

ARRIVAL_FILE_BYTES = 16 * 1024 * 1024  # bytes of the table behind a file of each arrival, so that tasks grow with it

MODEL_SQL = "case when user_id % 2 = 0 then 'even' else 'odd' end"
ARRIVED_REF = f"select {MODEL_SQL} as model, value, event_type from events where ts < timestamp '2024-01-08 00:00:00'"
ARRIVED_CUR = f"""select event_id, {MODEL_SQL} as model, substr(cast(ts as varchar(30)), 1, 10) as day,
    case when user_id % 6 = 0 then value * 1.5 else value end as value,
    case when user_id % 10 = 1 and event_type = 'click' then 'tap' else event_type end as event_type
    from events where ts >= timestamp '2024-01-08 00:00:00'"""


@query(
    "stream_monitor",
    f"""with ref as ({ARRIVED_REF}), cur as ({ARRIVED_CUR}),
    rl0 as (select model || '/value' as feature, value from ref where isfinite(value)),
    cl0 as (select day as batch, model || '/value' as feature, value from cur where isfinite(value)),
    span as (select feature, min(value) as lo, max(value) as hi from rl0 group by all),
    rl as (select feature, greatest(0, least(9, floor((value - lo) / (hi - lo) * 10)))::int::varchar as value from rl0 join span using (feature)),
    cl as (select batch, feature, greatest(0, least(9, floor((value - lo) / (hi - lo) * 10)))::int::varchar as value
        from cl0 join span using (feature)),
    rn as (select feature, count(*) as n from rl group by all), cm as (select feature, batch, count(*) as m from cl group by all),
    {CELLS}, {SHARES},
    crl as (select model || '/event_type' as feature, event_type as value from ref where event_type is not null),
    ccl as (select day as batch, model || '/event_type' as feature, event_type as value from cur where event_type is not null),
    crn as (select feature, count(*) as n from crl group by all), ccm as (select feature, batch, count(*) as m from ccl group by all),
    {chi_sql("c")},
    feat as (select batch, feature, psi as drift_score, psi >= 0.1 as drift_detected,
            case when psi >= 0.25 then 'high' when psi < 0.1 then 'low' else 'medium' end as severity from dist
        union all select batch, feature, p_value, p_value < 0.05,
            case when p_value >= 0.05 then 'low' when p_value < 0.001 then 'high' when p_value < 0.01 then 'medium' else 'low' end from chi),
    sizes as (select model, day as batch, count(*) as row_count from cur group by all having count(*) >= 10)
    select s.model, s.batch, split_part(feature, '/', 2) as feature, row_count, round(drift_score, 6) + 0.0 as drift_score, drift_detected, severity
    from feat join sizes s on s.batch = feat.batch and s.model = split_part(feature, '/', 1)""",
)
def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of three arrivals, each with a part of every batch of two models; a batch is graded when all has come."""
    folder = scratch_folder(spark, "arrivals")
    # one row per model and day, the same for every arrival
    sizes = checkpointed(derived(spark, sf_dir, f"select model, day, count(*) as total from ({ARRIVED_CUR}) group by model, day"))
    arriving = derived(spark, sf_dir, ARRIVED_CUR)
    files = max(1, -(-(plan_bytes(table(spark, sf_dir, "events")) or 0) // ARRIVAL_FILE_BYTES))
    arriving.repartition(3 * files, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    config = DriftConfig(numeric_test="psi", numeric_threshold=0.1)
    monitor_arrivals(
        stream.join(F.broadcast(sizes), ["model", "day"]), derived(spark, sf_dir, ARRIVED_REF), ["value", "event_type"], "day",
        f"{folder}/history", f"{folder}/checkpoint", config, expected="total",
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/history").select(
        "model", "batch", "feature", "row_count", r6("drift_score").alias("drift_score"), "drift_detected", "severity"
    )


# Index lines as they lie in storage; every 13th is cut off in the middle, as by a writer that died.
LINES = """select event_id, event_type, cast(user_id % 5 as varchar(9)) as model,
    '{"timestamp":"2024-02-01T00:00:00.000000Z","dataset_version_id":"v' || cast(event_id as varchar(20)) || '","drift_type":"tabular","overall_severity":"'
    || event_type || '","drift_share":0.' || cast(event_id % 9 as varchar(9)) || ',"drifted_feature_count":' || cast(event_id % 7 as varchar(9))
    || ',"json_path":"r/' || cast(event_id as varchar(20)) || '.json"}' as line from events"""
STORED = f"select event_id, event_type, model, case when event_id % 13 = 0 then substr(line, 1, 60) else line end as line from ({LINES})"


@query(
    "drift_history_scan",
    f"""with s as ({STORED})
    select cast(model as int) as model, case when event_id % 13 = 0 then null else 'v' || event_id end as dataset_version_id,
        case when event_id % 13 = 0 then null else event_type end as overall_severity,
        case when event_id % 13 = 0 then null else cast(event_id % 9 as double) / 10 end as drift_share,
        case when event_id % 13 = 0 then null else event_id % 7 end::bigint as drifted_feature_count,
        case when event_id % 13 = 0 then line end as rejected from s""",
)
def drift_history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a history read back: entries, and the lines that do not parse."""
    root = scratch_folder(spark, "index") + "/index"
    derived(spark, sf_dir, STORED).select("model", F.col("line").alias("value")).write.partitionBy("model").text(root)
    entries, rejected = hist.scan_history(spark, root)
    columns = ["model", "dataset_version_id", "overall_severity", "drift_share", "drifted_feature_count"]
    whole = entries.select(*columns, F.lit(None).cast("string").alias("rejected"))
    return whole.unionByName(rejected.select("model", F.col("value").alias("rejected")), allowMissingColumns=True)
