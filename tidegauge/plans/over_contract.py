"""Named queries: data contracts, fingerprints and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import DataContract
from tidegauge.operators import contract as ct
from tidegauge.operators import fingerprint as fp
from tidegauge.plans.catalog import derived, query, r6, table

# customers with missing balances and one segment that the contract does not know
CUSTOMERS = """
    select c_custkey, c_name, case when c_custkey % 17 = 0 then null else c_acctbal end as c_acctbal,
        case when c_custkey % 101 = 5 then 'UNKNOWN' when c_custkey % 13 = 0 then null else c_mktsegment end as c_mktsegment,
        case when c_nationkey < 17 then 'train' when c_nationkey < 21 then 'val' else 'test' end as split
    from customer"""
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CONTRACT = DataContract(
    "customers",
    "c_mktsegment",
    {"c_custkey": "int", "c_name": "string", "c_acctbal": "float", "c_mktsegment": "string", "c_phone": "datetime"},
    min_rows=200,
    max_null_fraction=0.06,
    label_classes=SEGMENTS,
)
IN_CLASSES = "(" + ", ".join(f"'{s}'" for s in SEGMENTS) + ")"
COLUMNS = "c_custkey, c_name, c_acctbal, c_mktsegment"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CUSTOMERS)


@query(
    "contract_columns",
    """select * from (values ('error', 'missing_column', 'c_phone'), ('warning', 'extra_column', 'split')) t(level, "check", "column")""",
)
def contract_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.column_table(customers(spark, sf_dir), CONTRACT)


PARTS_TEXT = """
    select cast(p_partkey as varchar(30)) as p_partkey, p_name, p_size, p_brand,
        case when p_size % 7 = 0 then 'n/a' else cast(p_retailprice as varchar(30)) end as p_retailprice from part"""


@query(
    "contract_dtypes",
    f"""with t as ({PARTS_TEXT}),
    n as (select count(*) filter (p_partkey is not null and try_cast(p_partkey as bigint) is null) as a,
        count(*) filter (p_name is not null and try_cast(p_name as bigint) is null) as b,
        count(*) filter (p_retailprice is not null and try_cast(p_retailprice as double) is null) as c,
        count(*) filter (p_brand is null and p_brand is not null) as d from t)
    select 'p_partkey' as "column", 'int' as declared, a as bad_values, a = 0 as ok from n
    union all select 'p_name', 'int', b, b = 0 from n union all select 'p_retailprice', 'float', c, c = 0 from n
    union all select 'p_brand', 'string', d, d = 0 from n""",
)
def contract_dtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = {"p_partkey": "int", "p_name": "int", "p_retailprice": "float", "p_brand": "string", "p_size": "date"}
    return ct.text_dtype_table(derived(spark, sf_dir, PARTS_TEXT), DataContract("parts", "p_brand", declared))


@query(
    "contract_min_rows",
    f"""with t as ({CUSTOMERS}) select split, count(*) as observed, 200::bigint as "limit", count(*) >= 200 as ok
    from t group by split""",
)
def contract_min_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.row_count_check(customers(spark, sf_dir), CONTRACT, "split")


def _null_rows(by: str) -> str:
    return " union all ".join(
        f"""select {by} as split, '{c}' as "column", count(*) filter ({c} is null) as nulls, count(*) as "rows" from t group by 1"""
        for c in COLUMNS.split(", ")
    )


@query(
    "contract_null_fraction",
    f"""with t as ({CUSTOMERS}), n as ({_null_rows('split')})
    select split, "column", nulls, "rows", round(nulls / "rows", 6) as fraction, nulls / "rows" <= 0.06 as ok from n""",
)
def contract_null_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ct.null_fraction_check(customers(spark, sf_dir), CONTRACT, "split")
    return out.withColumn("fraction", r6("fraction"))


@query(
    "contract_label_set",
    f"""with t as ({CUSTOMERS}) select distinct split, c_mktsegment as label from t
    where c_mktsegment is not null and c_mktsegment not in {IN_CLASSES}""",
)
def contract_label_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.unknown_labels(customers(spark, sf_dir), CONTRACT, "split")


@query(
    "contract_report",
    f"""with t as ({CUSTOMERS}), n as ({_null_rows('split')})
    select split, 'null_fraction' as "check", "column", round(nulls / "rows", 6) as observed, 0.06::double as "limit",
        nulls / "rows" <= 0.06 as ok from n
    union all select split, 'min_rows', null, count(*)::double, 200.0, count(*) >= 200 from t group by split
    union all select split, 'unknown_labels', 'c_mktsegment', count(distinct c_mktsegment)::double, 0.0, false from t
        where c_mktsegment is not null and c_mktsegment not in {IN_CLASSES} group by split
    union all select 'all', 'missing_column', 'c_phone', 1.0, 0.0, false
    union all select 'all', 'dtype', unnest(['c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment']), 0.0, 0.0, true""",
)
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.contract_report(customers(spark, sf_dir), CONTRACT, "split").withColumn("observed", r6("observed"))


NO_TEST = f"select * from ({CUSTOMERS}) where split <> 'test'"


@query(
    "contract_absent_split",
    f"""with t as ({NO_TEST}), n as ({_null_rows('split')}),
    r as (select split, count(*) as observed from t group by split union all select 'test', 0)
    select split, 'min_rows' as "check", null as "column", observed::double as observed, 200.0::double as "limit", observed >= 200 as ok from r
    union all select split, 'null_fraction', "column", round(nulls / "rows", 6), 0.06, nulls / "rows" <= 0.06 from n""",
)
def contract_absent_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without its test split fails the contract by that split's count."""
    out = ct.contract_report(derived(spark, sf_dir, NO_TEST), CONTRACT, "split").where("check in ('min_rows', 'null_fraction')")
    return out.withColumn("observed", r6("observed"))


@query(
    "null_fail_fast",
    f"""with t as ({CUSTOMERS}), n as ({_null_rows("'all'")})
    select "column", nulls from n where nulls > 0 and "column" <> 'c_mktsegment'""",
)
def null_fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.null_fail_fast(customers(spark, sf_dir), ["c_custkey", "c_name", "c_acctbal"])


@query(
    "contract_infer",
    """select * from (values ('c_custkey', 'int', 'feature', null), ('c_name', 'string', 'feature', null),
        ('c_nationkey', 'int', 'feature', null), ('c_acctbal', 'float', 'feature', null)) t("column", type, role, label_class)
    union all select distinct 'c_mktsegment', 'string', 'target', c_mktsegment from customer where c_mktsegment is not null""",
)
def contract_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.infer_table(table(spark, sf_dir, "customer"), "c_mktsegment")


@query(
    "unknown_classes",
    """select p_brand as label, count(*) as n from part where p_brand not in (
        select p_brand from part where p_type = 'ECONOMY' group by p_brand having count(*) > 15) group by p_brand""",
)
def unknown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    known = part.where("p_type = 'ECONOMY'").groupBy("p_brand").agg(F.count("*").alias("c")).where("c > 15")
    return ct.unknown_classes(part, "p_brand", known, "p_brand")


@query(
    "required_columns_batch",
    """select 'column' as "check", c as "column", c <> 'c_phone' as ok from (values ('c_acctbal'), ('c_name'), ('c_phone'), ('c_mktsegment')) t(c)
    union all select 'rows', null, count(*) >= 2 from customer""",
)
def required_columns_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.batch_readiness(customers(spark, sf_dir), ["c_acctbal", "c_name", "c_phone"], "c_mktsegment")


# --- fingerprints and versions --------------------------------------------------------------------------

_ORDER_TEXT = "concat_ws(chr(31), o_orderkey::varchar, o_custkey::varchar, coalesce(o_orderstatus, chr(30)), o_totalprice::varchar, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), coalesce(o_orderpriority, chr(30)))"
_SUMS = ", ".join(f"sum(('0x' || substr(h, {4 * i + 1}, 4))::bigint)::bigint as s{i}" for i in range(16))


@query(
    "dataset_fingerprint",
    f"""with r as (select sha256({_ORDER_TEXT}) as h from orders), t as (select count(*) as row_count, {_SUMS} from r)
    select substr(sha256(concat_ws(',', 'o_orderkey|o_custkey|o_orderstatus|o_totalprice|o_orderdate|o_orderpriority',
        row_count, {', '.join(f's{i}' for i in range(16))})), 1, 12) as version, row_count from t""",
)
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.dataset_fingerprint(table(spark, sf_dir, "orders"))


LEDGER = """
    select c_custkey as dataset, 'split' as stage, substr(sha2(c_mktsegment, 256), 1, 12) as signature from customer
    where c_acctbal > 0"""
WANTED = """
    select c_custkey as dataset, 'split' as stage, substr(sha2(case when c_nationkey < 5 then c_name else c_mktsegment end, 256), 1, 12)
        as signature from customer"""


@query(
    "skip_up_to_date",
    f"""select * from ({WANTED.replace(', 256)', ')').replace('sha2(', 'sha256(')}) w
    where not exists (select 1 from ({LEDGER.replace(', 256)', ')').replace('sha2(', 'sha256(')}) l
        where l.dataset = w.dataset and l.stage = w.stage and l.signature = w.signature)""",
)
def skip_up_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, wanted = derived(spark, sf_dir, LEDGER), derived(spark, sf_dir, WANTED)
    return fp.pending_work(wanted, ledger, ["dataset", "stage", "signature"])


RUNS = "select o_custkey as dataset, o_orderkey as version, o_orderdate as processed_at from orders"


@query(
    "latest_version",
    f"""select dataset, version, "at" from (select dataset, version, processed_at as "at", row_number() over (
        partition by dataset order by processed_at desc, version desc) as rn from ({RUNS})) where rn = 1""",
)
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.latest_version(derived(spark, sf_dir, RUNS), "dataset", "version", "processed_at")


@query(
    "version_mismatch",
    f"""with v as (select dataset, max_by(version, (processed_at, version)) as version from ({RUNS}) group by dataset)
    select r.dataset, r.version, r.processed_at, v.version as reference_version, r.version <> v.version as version_mismatch
    from ({RUNS}) r left join v using (dataset)""",
)
def version_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived(spark, sf_dir, RUNS)
    newest = fp.latest_version(runs, "dataset", "version", "processed_at")
    return fp.version_mismatch(runs, newest, "dataset", "version")
