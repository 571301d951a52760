"""Promotion, registry and audit rules over whole tables of models, versions and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import PromotionRule
from tidegauge.operators.as_of import SPAN_ROWS, as_of, with_span
from tidegauge.operators.ordered import BUCKET, running_sums

TOLERANCE = 1e-6
LOWER_IS_BETTER = ("mae", "mse", "rmse")
METRIC_PREFIX = "eval."
PRODUCTION, ARCHIVED = "Production", "Archived"
STALE_DAYS = 7
LINEAGE_DIGITS = 6
# fixed values: the metrics of each task that become tags, where a decision is kept, the answers to drift
LINEAGE_METRICS = {
    "classification": ("accuracy", "precision", "recall", "f1_score"),
    "regression": ("mae", "mse", "rmse", "r2"),
    "image_classification_cnn": ("accuracy", "precision", "recall", "f1_score"),
}
DECISION_ARTIFACT = "promotion/promotion_decision.json"
DRIFT_OPTIONS = ("fine tune", "retrain", "collect data", "adjust isp", "accept")
CANCELLED = "cancelled"
# fixed values: the lineage tags a version must carry, all of them first, then the ones that may not be empty
LINEAGE_TAGS = (
    "lineage.run_id",
    "lineage.pipeline_execution_id",
    "lineage.config_hash",
    "lineage.dataset_name",
    "lineage.dataset_version_id",
    "lineage.task_type",
    "lineage.algorithm",
    "lineage.train_rows",
    "lineage.trained_at",
    "lineage.promotion_outcome",
    "lineage.comparison_verdict",
    "lineage.decision_artifact",
)
REQUIRED_TAGS = (
    "lineage.run_id",
    "lineage.config_hash",
    "lineage.dataset_version_id",
    "lineage.task_type",
    "lineage.algorithm",
    "lineage.trained_at",
    "lineage.promotion_outcome",
)
# fixed values: the worst status of a stage decides that of its run
STATUS_ORDER = ("completed", "blocked", "cancelled", "failed")


# --- promotion ------------------------------------------------------------------------------------------


def metric_maps(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, metrics): the metrics of a run as a map, one entry per metric name."""
    newest = metrics.groupBy(*keys, "metric").agg(F.max("value").alias("value"))
    return newest.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))


def _passes(observed: Column, operator: Column, threshold: Column) -> Column:
    return (
        F.when(operator == ">=", observed >= threshold)
        .when(operator == "<=", observed <= threshold)
        .when(operator == ">", observed > threshold)
        .when(operator == "<", observed < threshold)
        .when(operator == "==", F.abs(observed - threshold) <= TOLERANCE)
    )


def rule_results(metrics: DataFrame, keys: list[str], rules: Sequence[PromotionRule]) -> DataFrame:
    """Every rule for every run: (keys…, rule_id, metric, observed, threshold, operator, description, passed).

    The rules are a short list in the plan, so no join is needed and a metric that is missing still gives a row.
    """
    listed = F.array(
        *[
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(r.metric).alias("metric"),
                F.lit(float(r.threshold)).alias("threshold"),
                F.lit(r.operator).alias("operator"),
                F.lit(r.description).alias("description"),
            )
            for r in rules
        ]
    )
    rows = metric_maps(metrics, keys).select(*keys, "metrics", F.inline(listed))
    observed = F.try_element_at("metrics", F.col("metric"))
    rows = rows.withColumn("observed", observed)
    passed = F.coalesce(_passes(F.col("observed"), F.col("operator"), F.col("threshold")), F.lit(False))
    missing = F.concat(F.lit("Metric '"), "metric", F.lit("' not found in evaluation report"))
    return rows.withColumns(
        {"passed": passed, "description": F.when(F.col("observed").isNull(), missing).otherwise(F.col("description"))}
    ).drop("metrics")


def violations(metrics: DataFrame, keys: list[str], rules: Sequence[PromotionRule]) -> DataFrame:
    """The rules a run breaks; a run without violations has no row."""
    return rule_results(metrics, keys, rules).where(~F.col("passed")).drop("passed")


def violations_by_split(metrics: DataFrame, keys: list[str], rules: Sequence[PromotionRule], choice: str) -> DataFrame:
    """Violations on the chosen split (val, test or both), tagged with it. A run that lacks a required test
    split gets the row ``missing_split``, which blocks it as an error does."""
    splits = {"val": ["val"], "test": ["test"], "both": ["val", "test"]}
    if choice not in splits:
        raise ValueError(f"split choice must be val, test or both, got {choice!r}")
    wanted = splits[choice]
    broken = violations(metrics.where(F.col("split").isin(*wanted)), [*keys, "split"], rules)
    seen = metrics.groupBy(*keys).agg(F.collect_set("split").alias("have"))
    lost = seen.select(*keys, F.explode(F.array_except(F.array(*[F.lit(s) for s in wanted]), F.col("have"))).alias("split"))
    shape = broken.schema
    absent = lost.select(
        *keys,
        "split",
        F.lit("missing_split").alias("rule_id"),
        *[F.lit(None).cast(shape[c].dataType).alias(c) for c in broken.columns if c not in (*keys, "split", "rule_id", "description")],
        F.concat(F.lit("no report for split "), "split").alias("description"),
    )
    return broken.unionByName(absent)


def compare_models(candidate: DataFrame, production: DataFrame, keys: list[str], metrics: Sequence[str]) -> DataFrame:
    """(keys…, metric, candidate, production, delta, verdict) of the listed metrics both sides have."""
    c = candidate.where(F.col("metric").isin(*metrics)).select(*keys, "metric", F.col("value").alias("candidate"))
    p = production.where(F.col("metric").isin(*metrics)).select(*keys, "metric", F.col("value").alias("production"))
    diff = F.col("candidate") - F.col("production")
    good = F.when(F.col("metric").isin(*LOWER_IS_BETTER), diff < 0).otherwise(diff > 0)
    verdict = F.when(F.abs(diff) <= TOLERANCE, "equal").when(good, "better").otherwise("worse")
    return c.join(p, [*keys, "metric"]).withColumns({"delta": F.bround(diff, 6), "verdict": verdict})


def overall_verdict(comparison: DataFrame, candidates: DataFrame, with_production: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, has_production_model, overall_verdict, is_better) for every candidate, compared or not."""
    folded = comparison.groupBy(*keys).agg(F.collect_set("verdict").alias("v"))
    known = with_production.select(*keys).distinct().withColumn("_has", F.lit(True))
    rows = candidates.select(*keys).distinct().join(known, keys, "left").join(folded, keys, "left")
    has = F.coalesce("_has", F.lit(False))
    single = F.when(F.size("v") == 1, F.col("v")[0]).otherwise("mixed")
    verdict = F.when(~has, "no_baseline").when(F.col("v").isNull(), "equal").otherwise(single)
    out = rows.select(*keys, has.alias("has_production_model"), verdict.alias("overall_verdict"))
    return out.withColumn("is_better", F.when(F.col("has_production_model"), F.col("overall_verdict") == "better"))


# --- registry -------------------------------------------------------------------------------------------


def current_production(versions: DataFrame, stage: str = PRODUCTION) -> DataFrame:
    """(model, version, run_id, candidates): the highest version in the stage, and how many are in it."""
    at_stage = versions.where(F.col("stage") == stage)
    return at_stage.groupBy("model").agg(
        F.max(F.struct(F.col("version").cast("int").alias("version"), "run_id")).alias("top"), F.count("*").alias("candidates")
    ).select("model", "top.version", "top.run_id", "candidates")


def production_metrics(versions: DataFrame, run_metrics: DataFrame) -> DataFrame:
    """(model, version, metric, value): evaluation metrics of the current production run, prefix removed."""
    evals = run_metrics.where(F.startswith("key", F.lit(METRIC_PREFIX))).select(
        "run_id", F.expr(f"substr(key, {len(METRIC_PREFIX) + 1})").alias("metric"), "value"
    )
    return current_production(versions).join(evals, "run_id").select("model", "version", "metric", "value")


def register_versions(requests: DataFrame, versions: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """(model, run_id, version, is_new): a run known to the registry keeps its highest version, the others get
    the next numbers of their model in order of request; requests without a time come last, by run_id."""
    known = versions.groupBy("model", "run_id").agg(F.max("version").alias("version"))
    wanted = requests.groupBy("model", "run_id").agg(F.min("requested_at").alias("requested_at"))
    kept = wanted.join(known, ["model", "run_id"]).select("model", "run_id", "version", F.lit(False).alias("is_new"))
    fresh = wanted.join(known, ["model", "run_id"], "left_anti")
    top = versions.groupBy("model").agg(F.max("version").alias("top"))
    # numbered span by span, so that a model with very many requests is not sorted by one task
    late = F.col("requested_at").isNull()
    spans = with_span(fresh, ["model"], F.col("requested_at"), span_rows)
    spans = spans.withColumn(BUCKET, F.struct(late.alias("late"), F.col(BUCKET).alias("span")))
    order = [F.col("requested_at").asc(), F.col("run_id").asc()]
    numbered = running_sums(spans, ["model"], order, {"rn": F.lit(1)}, bucketed=True).join(top, "model", "left")
    return kept.unionByName(
        numbered.select(
            "model", "run_id", (F.coalesce("top", F.lit(0)) + F.col("rn")).cast("bigint").alias("version"), F.lit(True).alias("is_new")
        )
    )


def fold_stages(versions: DataFrame, promotions: DataFrame) -> DataFrame:
    """Current stage of every version from the log of promotions (model, version, at, promoted_by, run_id).

    The last promotion of a model is in production, earlier promoted versions are archived.
    """
    own = promotions.groupBy("model", "version").agg(F.max(F.struct("at", "promoted_by", "run_id")).alias("p"))
    last = promotions.groupBy("model").agg(F.max(F.struct("at", "version")).alias("l"))
    rows = versions.select("model", "version").join(own, ["model", "version"], "left").join(last, "model", "left")
    stage = F.when(F.col("p").isNull(), "None").when(F.col("l.version") == F.col("version"), PRODUCTION).otherwise(ARCHIVED)
    return rows.select(
        "model",
        "version",
        stage.alias("stage"),
        F.col("p.at").alias("promoted_at"),
        F.col("p.promoted_by").alias("promoted_by"),
        F.col("p.run_id").alias("decision_run_id"),
    )


def _metric_text(value: Column) -> Column:
    """A metric rounded to 6 digits as other tools of the registry print it: 0.9, 1.0, 1.2e-05, nan."""
    v = F.bround(value.cast("double"), LINEAGE_DIGITS)
    plain = F.regexp_replace(v.try_cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    small = F.regexp_replace(F.regexp_replace(v.cast("string"), r"\.0E", "E"), r"E-(\d)$", "e-0$1")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    return (
        F.when(odd, F.regexp_replace(F.lower(v.cast("string")), "inf.*", "inf"))
        .when((v != 0) & (F.abs(v) < 1e-4), small)
        .otherwise(F.coalesce(plain, v.cast("string")))
    )


def lineage_tags(runs: DataFrame, metrics: DataFrame, decisions: DataFrame) -> DataFrame:
    """The lineage tags of every run, assembled, and checked by ``lineage_status``.

    ``runs`` is (run_id, task_type, dataset, tags, params), ``metrics`` (run_id, metric, value) with plain metric
    names, ``decisions`` (run_id, outcome, verdict). Only the task's own metrics become tags, rounded to 6 digits;
    null ones do not. A run without a decision lacks its outcome, so it is not complete. A task type that is not
    known has ``supported`` false and is never complete.
    """
    task = F.create_map(*[x for t, names in LINEAGE_METRICS.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in names]))])
    own = F.coalesce(F.try_element_at(task, F.col("task_type")), F.array().cast("array<string>"))
    scores = metric_maps(metrics.where("metric is not null and value is not null"), ["run_id"])
    chosen = decisions.groupBy("run_id").agg(F.max_by(F.struct("outcome", "verdict"), F.struct("outcome", "verdict")).alias("_d"))
    rows = runs.join(scores, "run_id", "left").join(chosen, "run_id", "left")

    def of(column: str, key: str) -> Column:
        return F.try_element_at(F.col(column), F.lit(key))

    values = (
        F.col("run_id").cast("string"),
        of("tags", "pipeline.execution_id"),
        of("tags", "pipeline.config_hash"),
        F.col("dataset"),
        of("tags", "pipeline.dataset_version_id"),
        F.col("task_type"),
        of("params", "algorithm"),
        of("params", "train_rows"),
        of("params", "trained_at"),
        F.col("_d.outcome"),
        F.col("_d.verdict"),
        F.lit(DECISION_ARTIFACT),
    )
    fixed = F.create_map(*[x for k, v in zip(LINEAGE_TAGS, values, strict=True) for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    wanted = F.map_filter(F.coalesce("metrics", F.create_map().cast("map<string,double>")), lambda k, v: F.array_contains(own, k))
    scored = F.transform_keys(F.transform_values(wanted, lambda k, v: _metric_text(v)), lambda k, v: F.concat(F.lit("lineage.eval."), k))
    built = rows.select("run_id", F.map_concat(fixed, scored).alias("tags"), (F.size(own) > 0).alias("supported"))
    return lineage_status(built).withColumn("complete", F.col("complete") & F.col("supported"))


def lineage_status(runs: DataFrame, tags: str = "tags") -> DataFrame:
    """Runs with ``missing`` (required tags that are absent or empty, sorted), ``complete`` and the tags kept."""
    required = F.array(*[F.lit(t) for t in REQUIRED_TAGS])
    missing = F.array_sort(
        F.filter(required, lambda t: F.coalesce(F.try_element_at(F.col(tags), t), F.lit("")) == F.lit(""))
    )
    known = F.array(*[F.lit(t) for t in LINEAGE_TAGS])
    kept = F.map_filter(
        F.col(tags),
        lambda k, v: (F.coalesce(v, F.lit("")) != "") & (F.array_contains(known, k) | F.startswith(k, F.lit("lineage.eval."))),
    )
    return runs.withColumns({"missing": missing, "kept_tags": kept}).withColumn("complete", F.size("missing") == 0)


def rollback_checks(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Rollback requests (request_id, model, to_version) with the current production version and a verdict:
    ok, not_positive, unknown_version, not_ready, incomplete_rollback or already_production."""
    target = versions.select("model", F.col("version").alias("to_version"), "status", "stage", "tags")
    now = current_production(versions).select("model", F.col("version").alias("from_version"), F.col("run_id").alias("from_run_id"))
    rows = requests.join(target, ["model", "to_version"], "left").join(now, "model", "left")
    by_cli = F.coalesce(F.try_element_at("tags", F.lit("promotion.promoted_by")), F.lit("")) == "rollback-cli"
    half = by_cli & F.try_element_at("tags", F.lit("governance.last_rollback_at")).isNull()
    verdict = (
        F.when(F.col("to_version") <= 0, "not_positive")
        .when(F.col("status").isNull(), "unknown_version")
        .when(F.col("status") != "READY", "not_ready")
        .when((F.col("stage") == PRODUCTION) & half, "incomplete_rollback")
        .when(F.col("stage") == PRODUCTION, "already_production")
        .otherwise("ok")
    )
    return rows.select("request_id", "model", "from_version", "to_version", "from_run_id", verdict.alias("verdict"))


def rollback_audit(checked: DataFrame, executed: DataFrame) -> DataFrame:
    """Audit rows of the accepted requests: an ``initiated`` row, and a ``completed`` one where it was executed.

    ``executed`` is (request_id, executed_at, executed_by, reason, done).
    """
    rows = checked.where("verdict = 'ok'").join(executed, "request_id")
    states = F.when(F.col("done"), F.array(F.lit("initiated"), F.lit("completed"))).otherwise(F.array(F.lit("initiated")))
    return rows.select(
        "request_id",
        F.lit("rollback").alias("event_type"),
        F.explode(states).alias("status"),
        "model",
        "from_version",
        "to_version",
        F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("no reason provided")).alias("reason"),
        "executed_at",
        "executed_by",
    )


def audit_status(audit: DataFrame) -> DataFrame:
    """(request_id, status): completed once its completing row exists."""
    done = F.bool_or(F.col("status") == "completed")
    return audit.groupBy("request_id").agg(F.when(done, "completed").otherwise("initiated").alias("status"))


# --- decisions, deployment, runs ------------------------------------------------------------------------


def drift_provenance(decisions: DataFrame, drift: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Decisions (…, model, decided_at) with the latest drift record (model, generated_at, …) before them."""
    out = as_of(decisions, drift, ["model"], "decided_at", "generated_at", span_rows)
    fields = [c for c in drift.columns if c != "model"]
    return out.select(
        *decisions.columns, F.col("match").isNotNull().alias("available"), *[F.col(f"match.{c}").alias(f"drift_{c}") for c in fields]
    )


def decision_records(decisions: DataFrame, metrics: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One record per decision (run_id, model, approved, reason, version, split) with its metrics and verdict."""
    joined = decisions.join(metric_maps(metrics, ["run_id"]), "run_id", "left").join(verdicts, "model", "left")
    return joined.select(
        "run_id",
        "model",
        F.when(F.col("approved"), "approved").otherwise("rejected").alias("outcome"),
        "reason",
        F.col("version").alias("dataset_version_id"),
        F.col("split").alias("evaluation_split"),
        F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"),
        F.struct("has_production_model", "overall_verdict", "is_better").alias("comparison"),
    )


def drift_responses(decisions: DataFrame, drift: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """The record of every answer to drift (decision_id, model, option, reason, decided_at), and whether it stands.

    ``drift`` is (model, generated_at, drift_type, severity, report). The answer is linked to the model's latest
    report before it; without one its drift fields are null and the report is the default name. ``problem`` is null
    for a valid answer, else unknown_option or reason_missing; only a cancelled answer needs no reason. Options are
    read without outer blanks and in lower case.
    """
    option = F.lower(F.trim("option"))
    reason = F.coalesce(F.trim("reason"), F.lit(""))
    linked = drift_provenance(decisions, drift.select("model", "generated_at", "drift_type", "severity", "report"), span_rows)
    known = option.isin(*DRIFT_OPTIONS, CANCELLED)
    problem = F.when(~F.coalesce(known, F.lit(False)), "unknown_option").when((option != CANCELLED) & (reason == ""), "reason_missing")
    return linked.select(
        "decision_id",
        "model",
        F.lit("1.0.0").alias("schema_version"),
        "decided_at",
        F.col("drift_drift_type").alias("drift_type"),
        "drift_severity",
        option.alias("option"),
        F.when(option == CANCELLED, "").otherwise(reason).alias("reason"),
        F.coalesce("drift_report", F.lit("drift_result.json")).alias("drift_report_linked"),
        problem.alias("problem"),
    )


def deployment_records(rows: DataFrame, runs: DataFrame, stage: str = PRODUCTION) -> DataFrame:
    """One nested record per pipeline row: the model served, the promotion behind it, and whether it may be deployed.

    ``rows`` holds the columns of ``readiness`` and (model, registry_run_id, promotion_run_id, reason, verdict,
    version_id, artifact_path); ``runs`` is (run_id, tags) with lineage tags. The registry's run comes before the
    promotion's; without a registry version the stage and what its tags say are null. Rows without a run in the
    registry, often the most, have nothing to meet and are not shuffled, where they would all go to one task.
    """
    tags = runs.select(F.col("run_id").alias("registry_run_id"), F.col("tags").alias("_tags"))
    ready, known = readiness(rows), F.col("registry_run_id").isNotNull()
    met = ready.where(known).join(tags, "registry_run_id", "left")
    joined = met.unionByName(ready.where(~known).withColumn("_tags", F.lit(None).cast(tags.schema["_tags"].dataType)))

    def tag(name: str) -> Column:
        return F.when(F.col("registry_version").isNotNull(), F.try_element_at("_tags", F.lit(f"lineage.{name}")))

    run = F.coalesce(F.when(F.col("registry_version").isNotNull(), F.col("registry_run_id")), F.col("promotion_run_id"))
    return joined.select(
        *[c for c in rows.columns if c == "request_id"],
        F.struct(
            F.col("model").alias("registry_name"),
            "registry_version",
            F.when(F.col("registry_version").isNotNull(), stage).alias("stage"),
            run.alias("run_id"),
            tag("algorithm").alias("algorithm"),
            tag("trained_at").alias("trained_at"),
            F.coalesce(tag("dataset_version_id"), F.col("version_id")).alias("dataset_version_id"),
            F.when(F.col("artifact_exists") & run.isNotNull(), F.col("artifact_path")).alias("local_artifact_path"),
        ).alias("model"),
        F.struct("outcome", F.col("promotion_run_id").alias("run_id"), "reason", F.col("verdict").alias("comparison_verdict")).alias("promotion"),
        F.struct("status", "warnings").alias("readiness"),
    )


def report_age(generated_at: Column, now: Column) -> dict[str, Column]:
    """Age columns of a report time given as text; text without a zone is UTC, unreadable text gives nulls."""
    clock = F.when(F.length(generated_at) == 10, F.concat(generated_at, F.lit("T00:00:00"))).otherwise(generated_at)
    has_zone = F.rlike(generated_at, F.lit(r"(Z|[+-]\d\d:?\d\d)$"))
    at = F.try_to_timestamp(F.when(has_zone, generated_at).otherwise(F.concat(clock, F.lit("Z"))))
    seconds = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(at) / 1e6
    days = F.floor(seconds / 86400).cast("bigint")
    return {"age_days": days, "age_hours": F.round(seconds / 3600, 1), "is_stale": days >= STALE_DAYS}


def readiness(rows: DataFrame) -> DataFrame:
    """Deploy status and warnings of (…, registry_reachable, registry_version, outcome, artifact_exists)."""
    status = (
        F.when(~F.col("registry_reachable"), "mlflow_unavailable")
        .when(F.col("registry_version").isNull(), "no_production_model")
        .when(F.coalesce("outcome", F.lit("")) != "approved", "promotion_not_approved")
        .otherwise("ready")
    )
    notes = [
        F.when(~F.col("registry_reachable"), "mlflow_registry_unreachable"),
        F.when(F.col("registry_reachable") & ~F.col("artifact_exists"), "local_artifact_missing"),
        F.when(F.col("outcome").isNull(), "promotion_decision_missing"),
    ]
    return rows.withColumns({"status": status, "warnings": F.array_compact(F.array(*notes))})


def run_status(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, status, stages, seconds): the worst stage status decides; seconds are the sum of the stages."""
    worst = F.lit(0)
    for rank, name in enumerate(STATUS_ORDER):
        worst = F.when(F.col("status") == name, F.lit(rank)).otherwise(worst)
    spent = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    names = F.array(*[F.lit(s) for s in STATUS_ORDER])
    out = stages.groupBy(run).agg(F.max(worst).alias("w"), F.count("*").alias("stages"), F.sum(spent).alias("seconds"))
    return out.select(run, names[F.col("w")].alias("status"), "stages", F.round("seconds", 6).alias("seconds"))


def servable_models(versions: DataFrame, runs: DataFrame, stage: str = PRODUCTION, only: str | None = None) -> DataFrame:
    """(model, version, run_id, dataset_version_id, servable): a run without its dataset version tag is listed
    as not servable. ``runs`` is (run_id, tags)."""
    chosen = versions if only is None else versions.where(F.col("model") == only)
    tag = F.nullif(F.try_element_at("tags", F.lit("pipeline.dataset_version_id")), F.lit(""))
    joined = current_production(chosen, stage).join(runs.select("run_id", tag.alias("dataset_version_id")), "run_id", "left")
    return joined.select("model", "version", "run_id", "dataset_version_id", F.col("dataset_version_id").isNotNull().alias("servable"))


def model_name(explicit: Column, project: Column, task: Column) -> Column:
    """The explicit registry name, or project-task with illegal characters as hyphens."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.regexp_replace(F.concat_ws("-", project, task), r"[^a-zA-Z0-9._\-]", "-"))
