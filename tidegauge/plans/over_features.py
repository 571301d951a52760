"""Named queries: fitted feature preparation and split statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import FeatureConfig
from tidegauge.operators import features as ft
from tidegauge.plans.catalog import derived, query, r6, table

PARTS = """
    select p_partkey, case when p_partkey % 17 = 0 then null else p_retailprice end as price,
        case when p_partkey % 23 = 1 then null else cast(p_size as double) end as size,
        case when p_partkey % 19 = 2 then null when p_partkey % 10 = 9 and p_size = 7 then 'Brand#new' else p_brand end as brand,
        p_type as type,
        case when p_partkey % 10 < 7 then 'train' when p_partkey % 10 < 9 then 'val' else 'test' end as split
    from part"""
SQL = f"with p as ({PARTS}), t as (select * from p where split = 'train')"
NUMERIC, CATEGORICAL = ["price", "size"], ["brand"]


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    all_rows = derived(spark, sf_dir, PARTS)
    return all_rows, all_rows.where("split = 'train'")


@query("select_features", f"with p as ({PARTS}) select price, size, brand, type from p")
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.select_features(parts(spark, sf_dir)[0], ["price", "size", "brand"], "type")


@query(
    "impute_numeric",
    f"""{SQL}, s as (select avg(price) as m, median(size) as d from t)
    select p_partkey, round(coalesce(price, m), 6) as price_mean, coalesce(size, d) as size_median,
        coalesce(price, -1.0::double) as price_constant from p, s""",
)
def impute_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = parts(spark, sf_dir)
    mean = ft.numeric_fills(train, ["price"], "mean")["price"]
    median = ft.numeric_fills(train, ["size"], "median")["size"]
    constant = ft.numeric_fills(train, ["price"], "constant", -1.0)["price"]
    return rows.select(
        "p_partkey",
        r6(F.coalesce("price", F.lit(mean))).alias("price_mean"),
        F.coalesce("size", F.lit(median)).alias("size_median"),
        F.coalesce("price", F.lit(constant)).alias("price_constant"),
    )


@query(
    "exact_quantiles",
    """with q as (select quantile_cont(l_extendedprice, [0.05, 0.5, 0.95]) as a, quantile_cont(l_quantity, [0.05, 0.5, 0.95]) as b
        from lineitem)
    select 'l_extendedprice' as feature, unnest([0.05, 0.5, 0.95])::double as prob, round(unnest(a), 6) as value from q
    union all select 'l_quantity', unnest([0.05, 0.5, 0.95])::double, round(unnest(b), 6) from q""",
)
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ft.quantiles(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], [0.05, 0.5, 0.95])
    return out.withColumn("value", r6("value"))


@query(
    "impute_categorical",
    f"""{SQL}, s as (select brand as top from t where brand is not null group by brand order by count(*) desc, brand limit 1)
    select p_partkey, coalesce(brand, top) as brand_frequent, coalesce(brand, 'none') as brand_constant from p, s""",
)
def impute_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = parts(spark, sf_dir)
    top = ft.categorical_fills(train, ["brand"], "most_frequent")["brand"]
    return rows.select(
        "p_partkey",
        F.coalesce("brand", F.lit(top)).alias("brand_frequent"),
        F.coalesce("brand", F.lit("none")).alias("brand_constant"),
    )


@query(
    "scale_standard",
    f"""{SQL}, s as (select avg(price) as m, stddev_pop(price) as d, avg(size) as sm, stddev_pop(size) as sd from t)
    select p_partkey, round((price - m) / d, 6) + 0.0 as price, round((size - sm) / sd, 6) + 0.0 as size from p, s""",
)
def scale_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = parts(spark, sf_dir)
    stats = ft.scale_stats(train, NUMERIC)
    return rows.select("p_partkey", *[r6(ft.scaled(F.col(c), stats[c], "standard")).alias(c) for c in NUMERIC])


@query(
    "scale_minmax",
    f"""{SQL}, s as (select min(price) as a, max(price) as b, min(size) as c, max(size) as d from t)
    select p_partkey, round((price - a) / (b - a), 6) + 0.0 as price, round((size - c) / (d - c), 6) + 0.0 as size from p, s""",
)
def scale_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = parts(spark, sf_dir)
    stats = ft.scale_stats(train, NUMERIC)
    return rows.select("p_partkey", *[r6(ft.scaled(F.col(c), stats[c], "minmax")).alias(c) for c in NUMERIC])


LINES = """
    select l_orderkey, l_linenumber, case when l_tax = 0.08 then 'X' when l_linenumber = 7 then null else l_returnflag end as flag,
        l_linestatus, case when l_shipdate < timestamp '1999-01-01 00:00:00' then 'train' else 'test' end as split
    from lineitem"""


@query(
    "encode_onehot",
    f"""with p as ({LINES.replace("when l_tax = 0.08 then 'X'", "when l_tax = 0.08 and l_shipdate >= timestamp '1999-01-01 00:00:00' then 'X'")})
    select l_orderkey, l_linenumber, coalesce((flag = 'A')::int, 0)::double as "flag_A", coalesce((flag = 'N')::int, 0)::double as "flag_N",
        coalesce((flag = 'R')::int, 0)::double as "flag_R", (l_linestatus = 'F')::int::double as "l_linestatus_F",
        (l_linestatus = 'O')::int::double as "l_linestatus_O" from p""",
)
def encode_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = LINES.replace(
        "when l_tax = 0.08 then 'X'", "when l_tax = 0.08 and l_shipdate >= timestamp '1999-01-01 00:00:00' then 'X'"
    )
    rows = derived(spark, sf_dir, sql)
    found = ft.categories(rows.where("split = 'train'"), ["flag", "l_linestatus"], 2000)
    columns = [x for c in ("flag", "l_linestatus") for x in ft.onehot_columns(c, F.col(c), found[c])]
    return rows.select("l_orderkey", "l_linenumber", *columns)


@query(
    "encode_onehot_rare",
    f"""{SQL}, f as (select brand, count(*) as n from t where brand is not null group by brand)
    select p_partkey, coalesce((brand in (select brand from f where n < 50))::int, 0)::double as rare,
        coalesce((brand in (select brand from f where n >= 50))::int, 0)::double as kept from p""",
)
def encode_onehot_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = parts(spark, sf_dir)
    found = ft.categories(train, ["brand"], 2000, min_frequency=50)["brand"]
    wide = rows.select("p_partkey", *ft.onehot_columns("brand", F.col("brand"), found))
    kept = [F.col(f"`brand_{v}`") for v in found["kept"]]
    total = sum(kept, F.lit(0.0))
    rare = F.col(f"brand_{ft.RARE}") if found["rare"] else F.lit(0.0)
    return wide.select("p_partkey", rare.alias("rare"), total.alias("kept"))


@query(
    "encode_ordinal",
    f"""{SQL}, c as (select brand, row_number() over (order by brand) - 1 as code from (select distinct brand from t where brand is not null))
    select p_partkey, p.brand, coalesce(code, -1)::bigint as brand_code from p left join c on c.brand = p.brand""",
)
def encode_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = parts(spark, sf_dir)
    out = ft.encode_ordinal(rows, "brand", ft.ordinal_table(train, "brand"), "brand_code")
    return out.select("p_partkey", "brand", "brand_code")


@query(
    "fit_transform_splits",
    f"""{SQL}, f as (select avg(price) as pm, avg(size) as sm,
        (select brand from t where brand is not null group by brand order by count(*) desc, brand limit 1) as top from t),
    i as (select coalesce(price, pm) as price, coalesce(size, sm) as size, coalesce(brand, top) as brand from t, f),
    s as (select avg(price) as m1, stddev_pop(price) as d1, avg(size) as m2, stddev_pop(size) as d2 from i),
    c as (select brand as b, row_number() over (order by brand) - 1 as code from (select distinct brand from i))
    select p_partkey, split, round((coalesce(price, pm) - m1) / d1, 6) + 0.0 as price,
        round((coalesce(size, sm) - m2) / d2, 6) + 0.0 as size, coalesce(code, -1)::double as brand, type
    from p cross join f cross join s left join c on c.b = coalesce(brand, top)""",
)
def fit_transform_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = parts(spark, sf_dir)
    config = FeatureConfig(null_policy="impute", scaling="standard", encoding="ordinal")
    fitted = ft.fit_features(train, NUMERIC + CATEGORICAL, "type", config)
    out = fitted.transform(rows, keep=("p_partkey", "split"))
    return out.withColumns({c: r6(c) for c in NUMERIC})


@query(
    "null_policy",
    f"""{SQL}, f as (select median(price) as pm, median(size) as sm from t)
    select p_partkey, 'passthrough' as policy, price, size, coalesce(brand, null) as brand, type from p
    union all select p_partkey, 'impute', coalesce(price, pm), coalesce(size, sm), coalesce(brand, 'none'), type from p, f""",
)
def null_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, train = parts(spark, sf_dir)
    impute = FeatureConfig("impute", numeric_strategy="median", categorical_strategy="constant", categorical_fill="none")
    out = None
    for config in (FeatureConfig(), impute):
        fitted = ft.fit_features(train, NUMERIC + CATEGORICAL, "type", config)
        one = fitted.transform(rows, keep=("p_partkey",)).withColumn("policy", F.lit(config.null_policy))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "split_stats",
    f"""with p as ({PARTS})
    select split, count(*) as "rows", 'price' as feature, count(*) filter (price is null) as nulls, round(avg(price), 6) as mean,
        round(stddev_samp(price), 6) as std, round(min(price), 6) as "min", round(max(price), 6) as "max" from p group by split
    union all select split, count(*), 'size', count(*) filter (size is null), round(avg(size), 6), round(stddev_samp(size), 6),
        round(min(size), 6), round(max(size), 6) from p group by split""",
)
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.split_stats(parts(spark, sf_dir)[0], NUMERIC, "split")


@query(
    "label_distribution",
    f"with p as ({PARTS}) select split, brand as label, count(*) as n from p group by all",
)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.label_distribution(parts(spark, sf_dir)[0], "brand", "split")


@query(
    "split_top_values",
    f"""with p as ({PARTS}), c as (select split, 'brand' as feature, brand as value, count(*) as n from p group by all
        union all select split, 'type', type, count(*) from p group by all)
    select split, feature, value, n, place from (select *, row_number() over (partition by split, feature
        order by n desc, value nulls last) as place from c) where place <= 10""",
)
def split_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.top_values(parts(spark, sf_dir)[0], ["brand", "type"], "split").withColumn("place", F.col("place").cast("bigint"))


@query(
    "label_index",
    """with c as (select p_brand as label, row_number() over (order by p_brand) - 1 as class_index from (select distinct p_brand from part))
    select p_partkey, p_brand, class_index::bigint as class_index from part join c on label = p_brand""",
)
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return ft.with_class_index(part, "p_brand", ft.label_index(part, "p_brand"))


FILES = """
    select o_orderkey, concat('images/', case when o_orderstatus = 'F' then 'a_drifted/' else 'b/' end, 'img_',
        cast(o_orderkey as varchar(30)), case when o_orderkey % 7 = 0 then '_drifted' when o_orderkey % 7 = 1 then '_drifted_1' else '' end,
        case when o_orderkey % 2 = 0 then '.png' else '.jpeg' end) as path from orders"""


@query(
    "flag_drifted",
    f"with f as ({FILES}) select o_orderkey, path, contains(regexp_extract(path, '([^/]*)$', 1), '_drifted') as is_drifted from f",
)
def flag_drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.flag_drifted(derived(spark, sf_dir, FILES), "path")
