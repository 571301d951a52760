"""Named queries: promotion, registry and audit rules over tables derived from orders and customers.

A customer stands for a model and its orders for the model's versions and runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import CLASSIFICATION_RULES, PromotionRule
from tidegauge.operators import governance as gv
from tidegauge.plans.catalog import derived, query, r6

MODEL = "concat('model-', cast(o_custkey as varchar(30)))"
RUN = "concat('run-', cast(o_orderkey as varchar(30)))"
VERSIONS = f"""
    select {MODEL} as model, row_number() over (partition by o_custkey order by o_orderkey) as version, {RUN} as run_id,
        case o_orderstatus when 'F' then 'Production' when 'O' then 'Staging' else 'Archived' end as stage,
        case when o_orderpriority = '5-LOW' then 'PENDING_REGISTRATION' else 'READY' end as status,
        o_orderdate as created_at, o_orderkey, o_custkey
    from orders"""
ACCURACY = "round(cast(55 + o_orderkey % 46 as double) / 100, 4)"
F1 = "round(cast(50 + (o_orderkey + o_custkey) % 51 as double) / 100, 4)"
RUN_METRICS = f"""
    select {RUN} as run_id, {MODEL} as model, 'eval.accuracy' as key, {ACCURACY} as value from orders
    union all select {RUN}, {MODEL}, 'eval.f1_score', {F1} from orders where o_orderpriority <> '4-NOT SPECIFIED'
    union all select {RUN}, {MODEL}, 'train.loss', cast(o_orderkey % 13 as double) from orders"""
METRICS = f"""select run_id, model, substr(key, 6) as metric, value,
    case when length(run_id) % 2 = 0 then 'val' else 'test' end as split from ({RUN_METRICS}) m where key like 'eval.%'"""
RULES = (
    *CLASSIFICATION_RULES,
    PromotionRule("below_one", "accuracy", 1.0, "<", "Accuracy must stay below one"),
    PromotionRule("not_exact", "f1_score", 0.75, "==", "F1 must be 0.75"),
    PromotionRule("above_half", "accuracy", 0.56, ">", "Accuracy must exceed 0.56"),
)


def _rule_sql(keys: str) -> str:
    rows = ", ".join(f"('{r.rule_id}', '{r.metric}', {r.threshold}::double, '{r.operator}', '{r.description}')" for r in RULES)
    return f"""
    rules as (select * from (values {rows}) r(rule_id, metric, threshold, operator, description)),
    runs as (select distinct {keys} from mx),
    ev as (select runs.*, rules.*, mx.value as observed from runs cross join rules left join mx
        on mx.metric = rules.metric and {' and '.join(f'mx.{k.strip()} = runs.{k.strip()}' for k in keys.split(','))}),
    bad as (select {keys}, rule_id, metric, observed, threshold, operator, case when observed is null then
            'Metric ''' || metric || ''' not found in evaluation report' else description end as description
        from ev where not coalesce(case operator when '>=' then observed >= threshold when '<=' then observed <= threshold
            when '>' then observed > threshold when '<' then observed < threshold
            else abs(observed - threshold) <= 1e-6 end, false))"""


@query("promotion_rules", f"with mx as ({METRICS}), {_rule_sql('run_id')} select * from bad")
def promotion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.violations(derived(spark, sf_dir, METRICS), ["run_id"], RULES)


@query(
    "promotion_split_choice",
    f"""with mx as ({METRICS}), {_rule_sql('model, split')},
    need as (select model, s as split from (select distinct model from mx), (values ('val'), ('test')) v(s))
    select * from bad union all select model, split, 'missing_split', null, null, null, null, 'no report for split ' || split
    from need where not exists (select 1 from mx where mx.model = need.model and mx.split = need.split)""".replace(
        f"mx as ({METRICS})", f"mx as (select model, split, metric, max(value) as value from ({METRICS}) group by all)"
    ),
)
def promotion_split_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = derived(spark, sf_dir, METRICS).groupBy("model", "split", "metric").agg(F.max("value").alias("value"))
    return gv.violations_by_split(metrics, ["model"], RULES, "both")


# candidate: the metrics of the newest run; production: those of the current production version
CANDIDATE = f"""
    select model, substr(key, 6) as metric, value + case when o_orderkey % 4 = 0 then 0.0000001 else 0 end as value
    from (select {MODEL} as model, {RUN} as run_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as rn
        from orders) o join (select run_id as r, key, value from ({RUN_METRICS}) x) m on o.run_id = m.r
    where rn = 1 and key like 'eval.%'"""
PRODUCTION = f"""
    select p.model, p.version, substr(key, 6) as metric, value from (
        select model, version, run_id, row_number() over (partition by model order by version desc) as rn
        from ({VERSIONS}) v where stage = 'Production') p
    join (select run_id as r, key, value from ({RUN_METRICS}) x) m on p.run_id = m.r where rn = 1 and key like 'eval.%'"""
COMPARED = f"""c as ({CANDIDATE}), p as ({PRODUCTION}),
    cmp as (select model, metric, c.value as candidate, p.value as production, round_even(c.value - p.value, 6) + 0.0 as delta,
        case when abs(c.value - p.value) <= 1e-6 then 'equal' when c.value > p.value then 'better' else 'worse' end as verdict
        from c join p using (model, metric) where metric in ('accuracy', 'f1_score'))"""
COMPARE_METRICS = ("accuracy", "f1_score")


@query("compare_models", f"with {COMPARED} select * from cmp")
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidate = derived(spark, sf_dir, CANDIDATE)
    production = gv.production_metrics(derived(spark, sf_dir, VERSIONS), derived(spark, sf_dir, RUN_METRICS))
    out = gv.compare_models(candidate, production, ["model"], COMPARE_METRICS)
    return out.withColumn("delta", F.col("delta") + F.lit(0.0))


@query(
    "compare_verdict",
    f"""with {COMPARED}, v as (select model, count(distinct verdict) as k, min(verdict) as one from cmp group by model)
    select m.model, has as has_production_model, case when not has then 'no_baseline' when k is null then 'equal'
        when k = 1 then one else 'mixed' end as overall_verdict, case when has then coalesce(k = 1 and one = 'better', false) end as is_better
    from (select distinct model, model in (select model from p) as has from c) m left join v using (model)""",
)
def compare_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidate = derived(spark, sf_dir, CANDIDATE)
    production = gv.production_metrics(derived(spark, sf_dir, VERSIONS), derived(spark, sf_dir, RUN_METRICS))
    comparison = gv.compare_models(candidate, production, ["model"], COMPARE_METRICS)
    return gv.overall_verdict(comparison, candidate, production, ["model"])


@query(
    "current_production",
    f"""select model, version::int as version, run_id, candidates from (select *, count(*) over (partition by model) as candidates,
        row_number() over (partition by model order by version desc) as rn from ({VERSIONS}) where stage = 'Production') where rn = 1""",
)
def current_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.current_production(derived(spark, sf_dir, VERSIONS))


@query("production_metrics", f"select model, version::int as version, metric, value from ({PRODUCTION})")
def production_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.production_metrics(derived(spark, sf_dir, VERSIONS), derived(spark, sf_dir, RUN_METRICS))


REGISTERED = f"select model, run_id, version from ({VERSIONS}) v where stage <> 'Archived'"
REQUESTS = f"select {MODEL} as model, {RUN} as run_id, o_orderdate as requested_at from orders where o_orderpriority <> '5-LOW'"


@query(
    "register_version",
    f"""with v as ({REGISTERED}), r as ({REQUESTS}), k as (select model, run_id, max(version) as version from v group by all),
    top as (select model, max(version) as top from v group by model),
    f as (select r.*, row_number() over (partition by r.model order by requested_at, r.run_id) as rn from r
        where not exists (select 1 from k where k.model = r.model and k.run_id = r.run_id))
    select r.model, r.run_id, k.version, false as is_new from r join k using (model, run_id)
    union all select f.model, f.run_id, coalesce(top, 0) + rn, true from f left join top using (model)""",
)
def register_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.register_versions(derived(spark, sf_dir, REQUESTS), derived(spark, sf_dir, REGISTERED))


PROMOTIONS = f"""
    select model, version, created_at as at_time, concat('clerk-', cast(o_orderkey % 7 as varchar(5))) as promoted_by, run_id
    from ({VERSIONS}) v where status = 'READY'"""


@query(
    "stage_transition",
    f"""with v as ({VERSIONS}), p as ({PROMOTIONS}),
    own as (select model, version, max_by(p, (at_time, promoted_by, run_id)) as r from p group by all),
    last as (select model, max_by(version, (at_time, version)) as top from p group by model)
    select v.model, v.version, case when own.r is null then 'None' when last.top = v.version then 'Production' else 'Archived' end as stage,
        own.r.at_time as promoted_at, own.r.promoted_by as promoted_by, own.r.run_id as decision_run_id
    from v left join own on own.model = v.model and own.version = v.version left join last on last.model = v.model""",
)
def stage_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived(spark, sf_dir, PROMOTIONS).withColumnRenamed("at_time", "at")
    return gv.fold_stages(derived(spark, sf_dir, VERSIONS), log)


TAG_VALUES = {
    "lineage.run_id": RUN,
    "lineage.pipeline_execution_id": "case when o_orderkey % 2 = 0 then '' else 'exec' end",
    "lineage.config_hash": "case when o_orderkey % 9 = 0 then '' else 'c0ffee' end",
    "lineage.dataset_name": "'orders'",
    "lineage.dataset_version_id": "case when o_orderkey % 5 = 0 then cast(null as varchar(10)) else 'd1' end",
    "lineage.task_type": "'classification'",
    "lineage.algorithm": "case when o_orderstatus = 'P' then '' else 'random_forest' end",
    "lineage.trained_at": "cast(cast(o_orderdate as date) as varchar(10))",
    "lineage.promotion_outcome": "'approved'",
    "lineage.eval.accuracy": "cast(o_orderkey % 100 as varchar(10))",
    "note": "'kept out'",
}


@query(
    "lineage_complete",
    f"""with t as (select {RUN} as run_id, [{', '.join(f"struct_pack(k := '{k}', v := ({v})::varchar)" for k, v in TAG_VALUES.items())}] as tags from orders),
    x as (select run_id, unnest(tags).k as k, unnest(tags).v as v from t)
    select run_id, coalesce(string_agg(k, ',' order by k) filter (k in ('lineage.run_id', 'lineage.config_hash',
            'lineage.dataset_version_id', 'lineage.task_type', 'lineage.algorithm', 'lineage.trained_at', 'lineage.promotion_outcome')
            and coalesce(v, '') = ''), '') as missing,
        count(*) filter (k in ('lineage.run_id', 'lineage.config_hash', 'lineage.dataset_version_id', 'lineage.task_type',
            'lineage.algorithm', 'lineage.trained_at', 'lineage.promotion_outcome') and coalesce(v, '') = '') = 0 as complete,
        string_agg(k, ',' order by k) filter (k <> 'note' and coalesce(v, '') <> '') as kept from x group by run_id""",
)
def lineage_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ", ".join(f"{v} as t{i}" for i, v in enumerate(TAG_VALUES.values()))
    rows = derived(spark, sf_dir, f"select {RUN} as run_id, {columns} from orders")
    pairs = [x for i, k in enumerate(TAG_VALUES) for x in (F.lit(k), F.col(f"t{i}").cast("string"))]
    out = gv.lineage_status(rows.select("run_id", F.create_map(*pairs).alias("tags")))
    return out.select(
        "run_id",
        F.array_join("missing", ",").alias("missing"),
        "complete",
        F.array_join(F.array_sort(F.map_keys("kept_tags")), ",").alias("kept"),
    )


TAGGED = f"""select model, version, run_id, stage, status, o_orderkey % 4 = 0 as by_cli, o_orderkey % 8 = 0 as rolled
    from ({VERSIONS}) v"""
ROLLBACKS = f"select {RUN} as request_id, {MODEL} as model, o_orderkey % 14 - 1 as to_version from orders"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, TAGGED)
    tags = F.map_from_arrays(
        F.array_compact(
            F.array(F.when(F.col("by_cli"), "promotion.promoted_by"), F.when(F.col("rolled"), "governance.last_rollback_at"))
        ),
        F.array_compact(F.array(F.when(F.col("by_cli"), "rollback-cli"), F.when(F.col("rolled"), "2024-01-01"))),
    )
    return rows.withColumn("tags", tags)


ROLLBACK_SQL = f"""v as ({TAGGED}), r as ({ROLLBACKS}),
    now as (select model, max_by(version, version) as from_version, max_by(run_id, version) as from_run_id from v
        where stage = 'Production' group by model),
    chk as (select request_id, r.model, now.from_version::int as from_version, to_version, from_run_id,
        case when to_version <= 0 then 'not_positive' when v.status is null then 'unknown_version' when v.status <> 'READY' then 'not_ready'
            when v.stage = 'Production' and by_cli and not rolled then 'incomplete_rollback'
            when v.stage = 'Production' then 'already_production' else 'ok' end as verdict
        from r left join v on v.model = r.model and v.version = r.to_version left join now on now.model = r.model)"""


@query("rollback_check", f"with {ROLLBACK_SQL} select * from chk")
def rollback_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.rollback_checks(derived(spark, sf_dir, ROLLBACKS), _tagged(spark, sf_dir))


EXECUTED = f"""select {RUN} as request_id, o_orderdate as executed_at, 'operator' as executed_by,
    case when o_orderkey % 3 = 0 then ' ' else 'bad batch' end as reason, o_orderstatus <> 'P' as done from orders"""


@query(
    "rollback_audit",
    f"""with {ROLLBACK_SQL}, e as ({EXECUTED}), rows as (select request_id, 'rollback' as event_type, model, from_version, to_version,
        case when trim(reason) = '' then 'no reason provided' else reason end as reason, executed_at, executed_by, done
        from chk join e using (request_id) where verdict = 'ok')
    select request_id, event_type, 'initiated' as status, model, from_version, to_version, reason, executed_at, executed_by,
        case when done then 'completed' else 'initiated' end as final_status from rows
    union all select request_id, event_type, 'completed', model, from_version, to_version, reason, executed_at, executed_by, 'completed'
        from rows where done""",
)
def rollback_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = gv.rollback_audit(rollback_check(spark, sf_dir), derived(spark, sf_dir, EXECUTED))
    status = gv.audit_status(audit).withColumnRenamed("status", "final_status")
    return audit.join(status, "request_id")


DECISIONS = """select event_id, cast(user_id as varchar(20)) as model, ts as decided_at from events where event_type = 'purchase'"""
DRIFT_LOG = """select cast(user_id as varchar(20)) as model, ts as generated_at, event_id as record_id,
    case when value > 60 then 'high' when value > 30 then 'medium' else 'low' end as severity
    from events where event_type <> 'purchase'"""


@query(
    "drift_provenance",
    f"""with d as ({DECISIONS}), r as ({DRIFT_LOG})
    select d.event_id, d.model, d.decided_at, r.record_id is not null as available, r.generated_at as drift_generated_at,
        r.record_id as drift_record_id, r.severity as drift_severity
    from d asof left join r on d.model = r.model and d.decided_at >= r.generated_at""",
)
def drift_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.drift_provenance(derived(spark, sf_dir, DECISIONS), derived(spark, sf_dir, DRIFT_LOG))


DECIDED = f"""select {RUN} as run_id, {MODEL} as model, o_orderstatus = 'F' as approved, o_orderpriority as reason,
    cast(o_orderkey % 9 as varchar(5)) as version, 'val' as split from orders"""


@query(
    "decision_record",
    f"""with {COMPARED}, v as (select model, count(distinct verdict) as k, min(verdict) as one from cmp group by model),
    mm as (select run_id, max(value) filter (metric = 'accuracy') as accuracy, count(*) as n from ({METRICS}) group by run_id)
    select d.run_id, d.model, case when approved then 'approved' else 'rejected' end as outcome, reason, d.version as dataset_version_id,
        split as evaluation_split, accuracy, n::int as metric_count,
        case when d.model not in (select model from p) then 'no_baseline' when k is null then 'equal' when k = 1 then one else 'mixed' end as verdict
    from ({DECIDED}) d left join mm using (run_id) left join v on v.model = d.model""",
)
def decision_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = gv.decision_records(
        derived(spark, sf_dir, DECIDED), derived(spark, sf_dir, METRICS), compare_verdict(spark, sf_dir)
    )
    return records.select(
        "run_id",
        "model",
        "outcome",
        "reason",
        "dataset_version_id",
        "evaluation_split",
        F.try_element_at("metrics", F.lit("accuracy")).alias("accuracy"),
        F.size("metrics").alias("metric_count"),
        F.col("comparison.overall_verdict").alias("verdict"),
    )


LINEAGE_RUNS = f"""select {RUN} as run_id, case when o_orderkey % 8 = 0 then 'other' when o_orderkey % 2 = 0 then 'classification'
        else 'image_classification_cnn' end as task_type, 'orders' as dataset,
    case when o_orderkey % 9 = 0 then '' else 'c0ffee' end as config_hash, concat('d', cast(o_custkey % 9 as varchar(5))) as version,
    case when o_orderstatus <> 'P' then 'random_forest' end as algorithm, cast(o_orderkey as varchar(20)) as train_rows,
    cast(cast(o_orderdate as date) as varchar(10)) as trained_at from orders"""
LINEAGE_DECIDED = f"""select {RUN} as run_id, case when o_orderstatus = 'F' then 'approved' else 'rejected' end as outcome,
    case when o_custkey % 2 = 0 then 'improvement' end as verdict from orders where o_orderpriority <> '1-URGENT'"""


@query(
    "lineage_tags",
    f"""with r as ({LINEAGE_RUNS}), d as ({LINEAGE_DECIDED}), m as ({METRICS}),
    t as (select run_id, unnest(['run_id', 'config_hash', 'dataset_name', 'dataset_version_id', 'task_type', 'algorithm', 'train_rows',
            'trained_at', 'promotion_outcome', 'comparison_verdict', 'decision_artifact']) as k,
        unnest([run_id, config_hash, dataset, version, task_type, algorithm, train_rows, trained_at, outcome, verdict,
            'promotion/promotion_decision.json']) as v from r left join d using (run_id)
        union all select run_id, 'eval.' || metric, value::varchar from m join r using (run_id) where task_type <> 'other'),
    f as (select run_id, coalesce(string_agg('lineage.' || k, ',' order by k) filter (coalesce(v, '') = '' and k in ('config_hash', 'algorithm',
            'promotion_outcome')), '') as missing,
        string_agg('lineage.' || k || '=' || v, ',' order by k) filter (coalesce(v, '') <> '') as kept from t group by run_id)
    select run_id, missing, missing = '' and task_type <> 'other' as complete, task_type <> 'other' as supported, kept from f join r using (run_id)""",
)
def lineage_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, LINEAGE_RUNS)
    tags = F.create_map(F.lit("pipeline.config_hash"), "config_hash", F.lit("pipeline.dataset_version_id"), "version")
    params = F.create_map(*[x for c in ("algorithm", "train_rows", "trained_at") for x in (F.lit(c), F.col(c))])
    runs = rows.select("run_id", "task_type", "dataset", tags.alias("tags"), params.alias("params"))
    out = gv.lineage_tags(runs, derived(spark, sf_dir, METRICS), derived(spark, sf_dir, LINEAGE_DECIDED))
    pairs = F.transform(F.array_sort(F.map_entries("kept_tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("run_id", F.array_join("missing", ",").alias("missing"), "complete", "supported", F.array_join(pairs, ",").alias("kept"))


ANSWERS = """select event_id as decision_id, cast(user_id as varchar(20)) as model, ts as decided_at,
    case event_id % 7 when 0 then ' Retrain' when 1 then 'accept' when 2 then 'cancelled' when 3 then 'ignore' when 4 then 'fine tune'
        when 5 then 'adjust isp' end as option,
    case when event_id % 5 = 0 then '  ' when event_id % 5 = 1 then cast(null as varchar(10)) else ' seen ' end as reason
    from events where event_type = 'purchase'"""
REPORTS = """select cast(user_id as varchar(20)) as model, ts as generated_at, case when event_id % 2 = 0 then 'tabular' else 'image_statistical' end
        as drift_type, case when value > 60 then 'high' when value > 30 then 'medium' else 'low' end as severity,
    concat('report_', cast(event_id as varchar(20)), '.json') as report from events where event_type <> 'purchase'"""


@query(
    "drift_responses",
    f"""with d as ({ANSWERS}), r as ({REPORTS}), j as (select d.*, lower(trim(d.option)) as o, coalesce(trim(d.reason), '') as w, drift_type, severity, report
        from d asof left join r on d.model = r.model and d.decided_at >= r.generated_at)
    select decision_id, model, '1.0.0' as schema_version, decided_at, drift_type, severity as drift_severity, o as option,
        case when o = 'cancelled' then '' else w end as reason, coalesce(report, 'drift_result.json') as drift_report_linked,
        case when o is null or o = 'ignore' then 'unknown_option' when o <> 'cancelled' and w = '' then 'reason_missing' end as problem from j""",
)
def drift_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.drift_responses(derived(spark, sf_dir, ANSWERS), derived(spark, sf_dir, REPORTS))


AGES = """select event_id, case when event_id % 10 = 0 then 'unknown' when event_id % 2 = 0 then
        concat(cast(cast(ts as date) as varchar(10)), 'T00:00:00Z') else concat(cast(cast(ts as date) as varchar(10)), ' 12:00:00') end as generated_at
    from events"""


@query(
    "report_age",
    f"""with a as ({AGES}), s as (select *, epoch(timestamp '2024-02-01 06:00:00') - epoch(try_cast(replace(generated_at, 'Z', '') as timestamp)) as sec from a)
    select event_id, floor(sec / 86400)::bigint as age_days, round(sec / 3600, 1) as age_hours, floor(sec / 86400) >= 7 as is_stale from s""",
)
def report_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, AGES)
    now = F.lit("2024-02-01T06:00:00Z").cast("timestamp")
    return rows.select("event_id", *[c.alias(n) for n, c in gv.report_age(F.col("generated_at"), now).items()])


READY = f"""select {RUN} as run_id, o_orderkey % 10 <> 0 as registry_reachable,
    case when o_orderstatus = 'F' then null else o_orderkey % 7 end as registry_version,
    case when o_orderpriority = '1-URGENT' then 'rejected' when o_orderpriority = '2-HIGH' then null else 'approved' end as outcome,
    o_custkey % 3 <> 0 as artifact_exists from orders"""


@query(
    "deploy_readiness",
    f"""with r as ({READY}) select run_id, case when not registry_reachable then 'mlflow_unavailable'
        when registry_version is null then 'no_production_model' when coalesce(outcome, '') <> 'approved' then 'promotion_not_approved'
        else 'ready' end as status,
        concat_ws(',', case when not registry_reachable then 'mlflow_registry_unreachable' end,
            case when registry_reachable and not artifact_exists then 'local_artifact_missing' end,
            case when outcome is null then 'promotion_decision_missing' end) as warnings from r""",
)
def deploy_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gv.readiness(derived(spark, sf_dir, READY))
    return out.select("run_id", "status", F.array_join("warnings", ",").alias("warnings"))


DEPLOYED = f"""select o_orderkey as request_id, {MODEL} as model, {RUN} as promotion_run_id, o_orderkey % 10 <> 0 as registry_reachable,
    case when o_orderstatus <> 'F' and o_orderkey % 10 <> 0 then o_orderkey % 7 end as registry_version,
    case when o_orderstatus <> 'F' and o_orderkey % 10 <> 0 then concat('reg-', cast(o_custkey as varchar(20))) end as registry_run_id,
    case when o_orderpriority = '1-URGENT' then 'rejected' when o_orderpriority = '2-HIGH' then null else 'approved' end as outcome,
    o_orderpriority as reason, 'equal' as verdict, concat('v', cast(o_orderkey % 5 as varchar(5))) as version_id,
    o_custkey % 3 <> 0 as artifact_exists, concat('artifacts/runs/', cast(o_orderkey as varchar(20))) as artifact_path from orders"""
REGISTRY_RUNS = """select concat('reg-', cast(c_custkey as varchar(20))) as run_id, c_mktsegment as algorithm,
    case when c_custkey % 4 <> 0 then concat('d', cast(c_nationkey as varchar(5))) end as version from customer"""


@query(
    "deployment_records",
    f"""with d as ({DEPLOYED}), r as ({REGISTRY_RUNS})
    select request_id, model, registry_version, case when registry_version is not null then 'Production' end as stage,
        coalesce(registry_run_id, promotion_run_id) as run_id, algorithm, coalesce(r.version, version_id) as dataset_version_id,
        case when artifact_exists then artifact_path end as local_artifact_path, outcome, reason, verdict,
        case when not registry_reachable then 'mlflow_unavailable' when registry_version is null then 'no_production_model'
            when coalesce(outcome, '') <> 'approved' then 'promotion_not_approved' else 'ready' end as status
    from d left join r on r.run_id = registry_run_id""",
)
def deployment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.lit("lineage.algorithm"), "algorithm", F.lit("lineage.dataset_version_id"), "version")
    runs = derived(spark, sf_dir, REGISTRY_RUNS).select("run_id", tags.alias("tags"))
    out = gv.deployment_records(derived(spark, sf_dir, DEPLOYED), runs)
    fields = ("registry_version", "stage", "run_id", "algorithm", "dataset_version_id", "local_artifact_path")
    return out.select(
        "request_id", F.col("model.registry_name").alias("model"), *[F.col(f"model.{c}").alias(c) for c in fields],
        "promotion.outcome", "promotion.reason", F.col("promotion.comparison_verdict").alias("verdict"), "readiness.status",
    )


STAGES = """select l_orderkey as run_id, l_linenumber as stage, case when l_returnflag = 'R' and l_linenumber = 3 then 'failed'
        when l_returnflag = 'A' and l_linenumber = 2 then 'cancelled' when l_tax = 0.08 then 'blocked' else 'completed' end as status,
    l_shipdate as started_at, l_shipdate + interval '90' second as ended_at from lineitem"""


@query(
    "run_status",
    f"""with s as ({STAGES}) select run_id, case when bool_or(status = 'failed') then 'failed' when bool_or(status = 'cancelled')
        then 'cancelled' when bool_or(status = 'blocked') then 'blocked' else 'completed' end as status, count(*) as stages,
        round(sum(epoch(ended_at) - epoch(started_at)), 6)::double as seconds from s group by run_id""",
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gv.run_status(derived(spark, sf_dir, STAGES))


RUN_TAGS = f"select {RUN} as run_id, case when o_orderkey % 6 = 0 then '' else concat('v', cast(o_custkey % 9 as varchar(5))) end as tag from orders"


@query(
    "servable_models",
    f"""with v as (select model, version, run_id, row_number() over (partition by model order by version desc) as rn
        from ({VERSIONS}) where stage = 'Production'), t as ({RUN_TAGS})
    select model, version::int as version, run_id, nullif(tag, '') as dataset_version_id, tag <> '' as servable
    from v join t using (run_id) where rn = 1""",
)
def servable_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = derived(spark, sf_dir, RUN_TAGS).select("run_id", F.create_map(F.lit("pipeline.dataset_version_id"), "tag").alias("tags"))
    return gv.servable_models(derived(spark, sf_dir, VERSIONS), tags)


NAMES = """select p_partkey, case when p_partkey % 4 = 0 then concat('named-', p_type) when p_partkey % 4 = 1 then '' end as explicit,
    p_brand as project, p_type as task from part"""


@query(
    "model_name",
    f"""with n as ({NAMES}) select p_partkey, coalesce(nullif(explicit, ''), regexp_replace(project || '-' || task, '[^a-zA-Z0-9._\\-]', '-', 'g')) as model
    from n""",
)
def model_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, NAMES)
    return rows.select("p_partkey", gv.model_name(F.col("explicit"), F.col("project"), F.col("task")).alias("model"))
