"""Named queries: scans, sinks and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import DataContract
from tidegauge.operators import metrics as mt
from tidegauge.operators.history import history_index
from tidegauge.plans.catalog import derived, query, r6, table
from tidegauge.plans.over_drift import TABLE, drift_records
from tidegauge.plans.over_governance import COMPARED, RUN, compare_models
from tidegauge.plans.over_history import RESULTS
from tidegauge.plans.over_images import distance_sql, gray, image_records
from tidegauge.plans.over_metrics import SCORED, metric_sql
from tidegauge.session import scratch_folder
from tidegauge.sources import history as hist
from tidegauge.sources import metrics_sink as sink
from tidegauge.sources import tables as src


@query("scan_dataset", "select l_orderkey, l_quantity, l_extendedprice, l_returnflag from lineitem")
def scan_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.scan_dataset(spark, f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")


PART_CONTRACT = DataContract(
    "part", "p_type", {"p_partkey": "int", "p_name": "string", "p_type": "string", "p_size": "int", "p_retailprice": "float"}
)


@query(
    "scan_dataset_csv",
    "select p_partkey, p_name, p_type, p_size::bigint as p_size, p_retailprice from part",
)
def scan_dataset_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table through a CSV file and back by its contract."""
    path = scratch_folder(spark, "csv") + "/part.csv"
    table(spark, sf_dir, "part").select(*PART_CONTRACT.types).write.option("header", "true").csv(path)
    return src.scan_dataset(spark, path, PART_CONTRACT)


VERSIONED = """select o_orderkey, o_totalprice, o_orderpriority, case when o_orderkey % 3 = 0 then 'v1' else 'v2' end as version,
    case when month(o_orderdate) <= 9 then 'train' else 'test' end as split from orders"""


@query(
    "scan_reference",
    f"select o_orderkey, o_totalprice, o_orderpriority from ({VERSIONED}) where version = 'v2' and split = 'train'",
)
def scan_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = src.select_version(derived(spark, sf_dir, VERSIONED), version="v2", split="train")
    return out.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    "tensor_table_io",
    "select vec_id, label, label % 2 = 1 as is_drifted, 'v7' as version_id, round(list_sum(embedding::double[]), 6) + 0.0 as total from embeddings",
)
def tensor_table_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "tensors") + "/train.parquet"
    images = gray(spark, sf_dir).withColumn("is_drifted", F.col("label") % 2 == 1)
    src.write_tensors(images, path, "v7")
    back = src.read_tensors(spark, path, "v7")
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", "label", "is_drifted", "version_id", r6(total).alias("total"))


@query(
    "drift_history_append",
    f"""with r as ({RESULTS}) select model::int as model, generated_at as "timestamp", drift_type, severity as overall_severity, drift_share,
        drift_score, 'records/' || event_id || '.json' as json_path from r""",
)
def drift_history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows appended to a history in two runs, read back by the history scan."""
    root = scratch_folder(spark, "history") + "/index"
    rows = derived(spark, sf_dir, RESULTS)
    nested = rows.withColumn("overall", F.struct("severity", "drift_share", "drift_score"))
    path = F.concat(F.lit("records/"), F.col("event_id").cast("string"), F.lit(".json"))
    for late in (False, True):
        part = nested.where((F.col("generated_at") >= F.lit("2024-01-15").cast("timestamp_ntz")) == late)
        stamped = part.withColumn("generated_at", F.col("generated_at").cast("timestamp"))
        index = history_index(stamped, F.concat(F.col("model").cast("string"), F.lit("|"), path))
        split = index.withColumn("model", F.split("json_path", r"\|")[0]).withColumn("json_path", F.split("json_path", r"\|")[1])
        hist.append_history(split, root, "model")
    entries, _ = hist.scan_history(spark, root)
    return entries.select(
        F.col("model").cast("int").alias("model"),
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        "drift_type",
        "overall_severity",
        "drift_share",
        "drift_score",
        "json_path",
    )


@query(
    "metrics_long_sink",
    f"""with s as ({SCORED}), {metric_sql('model, split')}
    select model, split, 'eval.' || metric as key, value from m unpivot (value for metric in (accuracy, "precision", recall, f1_score))""",
)
def metrics_long_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = mt.classification_metrics(derived(spark, sf_dir, SCORED), "y", "p", ["model", "split"])
    pairs = [x for m in mt.CLASSIFICATION for x in (F.lit(m), F.col(m))]
    reports = wide.select("model", "split", F.create_map(*pairs, F.lit("averaging"), F.lit(None).cast("double")).alias("metrics"))
    return sink.evaluation_rows(reports, ["model", "split"])


@query("metrics_comparison_rows", f"with {COMPARED} select model, 'comparison.delta.' || metric as key, delta as value from cmp")
def metrics_comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.comparison_rows(compare_models(spark, sf_dir), ["model"])


@query(
    "metrics_drift_rows",
    f"""{TABLE} select g.batch, 'drift.' || g.feature || '.score' as key, round(g.drift_score, 6) + 0.0 as value, o.severity,
        (o.drift_share >= 0.5)::varchar as detected, o.drifted_feature_count::varchar as drifted
    from graded g join overall o using (batch) where batch in (select batch from cur group by batch having count(*) >= 10)""",
)
def metrics_drift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows of the drift records with three of their tags."""
    records = drift_records(spark, sf_dir)

    def tag(name: str):
        return F.element_at("tags", F.lit(f"drift.{name}"))

    tags = sink.drift_tags(records, ["batch"]).select(
        "batch",
        tag("overall_severity").alias("severity"),
        tag("dataset_drift_detected").alias("detected"),
        tag("drifted_feature_count").alias("drifted"),
    )
    return sink.drift_rows(records, ["batch"]).join(tags, "batch").withColumn("value", r6("value"))


@query(
    "metrics_image_drift_rows",
    f"""{distance_sql("'gray'")} select batch, k as key, round(statistic, 6) as value
    from ws, (values ('drift.image.overall_score'), ('drift.image.gray_score')) t(k)""",
)
def metrics_image_drift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.image_drift_rows(image_records(spark, sf_dir), ["batch"]).withColumn("value", r6("value"))


UNSAFE = """select event_id, case when event_id % 4 = 0 then cast('NaN' as double) when event_id % 4 = 1 then cast('Infinity' as double)
    when event_id % 4 = 2 then -cast('Infinity' as double) else value end as value, event_type from events"""


@query(
    "json_safe_record",
    f"""select event_id, '{{"event_id":' || event_id || ',"value":' || case when isfinite(value) then value::varchar else 'null' end
        || ',"event_type":"' || event_type || '"}}' as record from ({UNSAFE})""",
)
def json_safe_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, UNSAFE)
    out = sink.json_records(rows)
    return out.select(F.get_json_object("record", "$.event_id").cast("bigint").alias("event_id"), "record")


@query(
    "run_ledger_rows",
    f"""select {RUN.replace('cast(o_orderkey as varchar(30))', 'o_orderkey::varchar')} as run_id, 'random_forest' as algorithm,
        case when o_orderkey % 2 = 0 then 'null' else (o_orderkey % 12)::varchar end as max_depth, o_orderkey::varchar as train_rows from orders""",
)
def run_ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records as text maps, an open hyperparameter written ``null``."""
    rows = derived(
        spark,
        sf_dir,
        f"""select {RUN} as run_id, case when o_orderkey % 2 = 0 then null else o_orderkey % 12 end as max_depth, o_orderkey as train_rows
        from orders""",
    )
    params = F.create_map(
        F.lit("algorithm"), F.lit("random_forest"),
        F.lit("hp.max_depth"), F.coalesce(F.col("max_depth").cast("string"), F.lit("null")),
        F.lit("train_rows"), F.col("train_rows").cast("string"),
    )
    mapped = rows.select("run_id", params.alias("p"))
    return mapped.select(
        "run_id",
        F.element_at("p", F.lit("algorithm")).alias("algorithm"),
        F.element_at("p", F.lit("hp.max_depth")).alias("max_depth"),
        F.element_at("p", F.lit("train_rows")).alias("train_rows"),
    )
