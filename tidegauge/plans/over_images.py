"""Named queries on array columns. An embedding of 64 numbers is read as an 8x8 gray image, as a 4x4 image of
four channels, or as a vector; labels below 5 are the reference, every other label is a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.severity import image_severity
from tidegauge.operators import image_drift as im
from tidegauge.operators import mmd, pixels as px
from tidegauge.plans.catalog import derived, query, r6, table
from tidegauge.plans.monitor import monitor_embeddings, monitor_images
from tidegauge.plans.over_drift import ECDF, WASS


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.as_images(table(spark, sf_dir, "embeddings"), "embedding", 8, 8, 1).drop("embedding")


def colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.as_images(table(spark, sf_dir, "embeddings"), "embedding", 4, 4, 4).drop("embedding")


def sides(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    return images.where("label < 5"), images.where("label >= 5")


FLAT = "select vec_id, label, unnest(range(0, 64)) as pixel, unnest(embedding)::double as value from embeddings"


def flat(df: DataFrame, *keys: str) -> DataFrame:
    out = px.pixel_flatten(df, ["vec_id", *keys])
    return out.select("vec_id", *keys, F.col("pixel").cast("bigint").alias("pixel"), r6("value").alias("value"))


@query("pixel_scale", f"select vec_id, pixel, round(value / 255, 6) + 0.0 as value from ({FLAT})")
def pixel_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(gray(spark, sf_dir).withColumn("pixels", px.pixel_scale(F.col("pixels"))))


@query(
    "pixel_grayscale",
    f"""select vec_id, pixel // 4 as pixel, round(sum(value * case pixel % 4 when 0 then 0.299 when 1 then 0.587
        when 2 then 0.114 else 0 end), 6) + 0.0 as value from ({FLAT}) group by vec_id, pixel // 4""",
)
def pixel_grayscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(px.pixel_grayscale(colour(spark, sf_dir)))


@query("pixel_flatten", f"select vec_id, pixel, round(value, 6) + 0.0 as value from ({FLAT})")
def pixel_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(gray(spark, sf_dir))


STATS = f"select pixel % 4 as channel, avg(value) as mean, stddev_pop(value) as std from ({FLAT}) where label < 5 group by 1"


@query(
    "channel_stats",
    f"select channel, round(mean, 6) + 0.0 as mean, round(case when std > 0 then std else 1 end, 6) as std from ({STATS})",
)
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = px.channel_stats(sides(colour(spark, sf_dir))[0])
    return out.select(F.col("channel").cast("bigint").alias("channel"), r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    "channel_normalize",
    f"""select vec_id, pixel, round((value - mean) / std, 6) + 0.0 as value from ({FLAT}) f join ({STATS}) s on s.channel = f.pixel % 4""",
)
def channel_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = colour(spark, sf_dir)
    return flat(px.channel_normalize(images, px.channel_stats(sides(images)[0])))


@query(
    "augment_replicas",
    f"select vec_id, label, c as copy_no, pixel, round(value, 6) + 0.0 as value from ({FLAT}), (select unnest(range(0, 3))::int as c)",
)
def augment_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(px.augment_replicas(gray(spark, sf_dir), "vec_id", 3), "label", "copy_no")


@query("augment_geometric")
def augment_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = px.augment_replicas(gray(spark, sf_dir), "vec_id", 3)
    return px.augment_geometric(copies, "vec_id", 42, padding=2).select("vec_id", "label", "copy_no", "pixels")


@query("augment_photometric")
def augment_photometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = px.augment_replicas(colour(spark, sf_dir), "vec_id", 2)
    return px.augment_photometric(copies, "vec_id", 42, 0.2, 0.2, 0.2).select("vec_id", "label", "copy_no", "pixels")


@query(
    "pixel_flip",
    f"select vec_id, (pixel // 8 * 8 + 7 - pixel % 8)::bigint as pixel, round(value, 6) + 0.0 as value from ({FLAT})",
)
def pixel_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(gray(spark, sf_dir).withColumn("pixels", px.flip_horizontal()))


def resize_sql(name: str, size: int, wanted: int) -> str:
    """The weights of a bilinear resize of one side: (fresh, held, weight)."""
    spot = f"least(greatest((p + 0.5) * {size} / {wanted} - 0.5, 0), {size - 1})"
    return f"""{name}_spots as (select p as fresh, ({spot})::double as spot from (select unnest(range(0, {wanted})) as p)),
    {name} as (select fresh, floor(spot)::bigint as held, 1 - (spot - floor(spot)) as w from {name}_spots
        union all select fresh, least(floor(spot) + 1, {size - 1})::bigint, spot - floor(spot) from {name}_spots)"""


@query(
    "pixel_resize",
    f"""with f as ({FLAT}), {resize_sql('by_row', 8, 6)}, {resize_sql('by_col', 8, 5)}
    select vec_id, by_row.fresh * 5 + by_col.fresh as pixel, round(sum(by_row.w * by_col.w * value), 6) + 0.0 as value
    from f join by_row on by_row.held = f.pixel // 8 join by_col on by_col.held = f.pixel % 8 group by vec_id, by_row.fresh, by_col.fresh""",
)
def pixel_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(px.pixel_resize(gray(spark, sf_dir), 6, 5))


BYTES = f"select vec_id, label, pixel, greatest(least(round(value * 128 + 128), 255), 0) as value from ({FLAT})"


@query(
    "batch_prepare",
    f"""with f as ({BYTES}), s as (select pixel % 4 as channel, avg(value / 255) as mean, stddev_pop(value / 255) as std from f where label < 5 group by 1),
    {resize_sql('by_row', 4, 3)}, {resize_sql('by_col', 4, 6)},
    z as (select vec_id, (by_row.fresh * 6 + by_col.fresh) * 4 + pixel % 4 as pixel, sum(by_row.w * by_col.w * value) / 255 as value
        from f join by_row on by_row.held = f.pixel // 16 join by_col on by_col.held = f.pixel // 4 % 4 where label >= 5 group by all)
    select vec_id, pixel, round((value - mean) / std, 6) + 0.0 as value from z join s on s.channel = z.pixel % 4""",
)
def batch_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings read as images of whole numbers from 0 to 255, with the statistics of the scaled reference."""
    whole = F.transform("pixels", lambda x: F.greatest(F.least(F.round(x * 128 + 128), F.lit(255.0)), F.lit(0.0)))
    reference, batch = sides(colour(spark, sf_dir).withColumn("pixels", whole))
    stats = px.channel_stats(reference.withColumn("pixels", px.pixel_scale(F.col("pixels"))))
    return flat(px.prepare_batch(batch, stats, 3, 6))


SCENARIO_EFFECT = {"brightness_high": "value + 0.5", "brightness_low": "value - 0.5", "contrast_low": "value * 0.5"}
SCENARIO_PIXEL = {
    "horizontal_flip": "pixel // 8 * 8 + 7 - pixel % 8",
    "rotation_180": "63 - pixel",
    # the source pixel (r, c) of a clockwise quarter turn lands in row c, column 7 - r
    "rotation_90": "pixel % 8 * 8 + 7 - pixel // 8",
}


@query(
    "perturb_scenarios",
    " union all ".join(
        [
            f"select vec_id, '{n}' as scenario, pixel, round({e}, 6) + 0.0 as value from ({FLAT})"
            for n, e in SCENARIO_EFFECT.items()
        ]
        + [
            f"select vec_id, '{n}', ({e})::bigint, round(value, 6) + 0.0 from ({FLAT})" for n, e in SCENARIO_PIXEL.items()
        ]
    ),
)
def perturb_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = px.perturb(gray(spark, sf_dir), "vec_id")
    return flat(many.where(F.col("scenario").isin(*SCENARIO_EFFECT, *SCENARIO_PIXEL)), "scenario")


@query("perturb_noise_blur")
def perturb_noise_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = px.perturb(gray(spark, sf_dir), "vec_id")
    return many.where("scenario in ('gaussian_noise', 'gaussian_blur')").select("vec_id", "scenario", "pixels")


# --- image drift ----------------------------------------------------------------------------------------


def distance_sql(channel: str) -> str:
    return f"""with f as (select *, {channel} as feature from ({FLAT})),
    rl as (select feature, value from f where label < 5 and feature is not null),
    cl as (select label::varchar as batch, feature, value from f where label >= 5 and feature is not null),
    rn as (select feature, count(*) as n from rl group by all),
    cm as (select feature, batch, count(*) as m from cl group by all), {ECDF}, {WASS}"""


@query(
    "channel_wasserstein",
    f"""{distance_sql("case pixel % 4 when 0 then 'r' when 1 then 'g' when 2 then 'b' end")}
    select batch, feature as channel, round(statistic, 6) as drift_score,
        round(avg(statistic) over (partition by batch), 6) as overall_score from ws""",
)
def channel_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = im.channel_wasserstein(*sides(colour(spark, sf_dir)), "label")
    overall = im.overall_score(channels).withColumnRenamed("drift_score", "overall_score")
    out = channels.join(overall, "batch")
    return out.withColumns({c: r6(c) for c in ("drift_score", "overall_score")})


@query(
    "channel_wasserstein_gray",
    f"""{distance_sql("'gray'")} select batch, feature as channel, round(statistic, 6) as drift_score from ws""",
)
def channel_wasserstein_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = im.channel_wasserstein(*sides(gray(spark, sf_dir)), "label")
    return out.withColumn("drift_score", r6("drift_score"))


def _mirror(x: str) -> str:
    return f"(case when {x} < 0 then -({x}) - 1 when {x} > 7 then 15 - ({x}) else {x} end)"


# level 1 of an 8x8 image: five-tap Gaussian of sigma 0.5 in both directions, then every second pixel
PYRAMID = f"""with f0 as ({FLAT}), kw as (select o, exp(-0.5 * (o / 0.5) ** 2) as w0 from (select unnest([-2, -1, 0, 1, 2]) as o)),
    kn as (select o, w0 / sum(w0) over () as w from kw), rc as (select unnest(range(0, 4)) as p),
    taps as (select r.p as r, c.p as c, a.w * b.w as w, {_mirror('2 * r.p + a.o')} * 8 + {_mirror('2 * c.p + b.o')} as pixel
        from rc r, rc c, kn a, kn b),
    f as (select label, '0/gray' as feature, value from f0
        union all select label, '1/gray', sum(w * value) from f0 join taps using (pixel) group by vec_id, label, r, c),
    rl as (select feature, value from f where label < 5), cl as (select label::varchar as batch, feature, value from f where label >= 5),
    rn as (select feature, count(*) as n from rl group by all),
    cm as (select feature, batch, count(*) as m from cl group by all), {ECDF}, {WASS},
    lv as (select batch, feature[1]::int as level, 'gray' as channel, round(statistic, 6) as drift_score from ws),
    pf as (select batch, round_even(max(drift_score) filter (level = 0) / greatest(max(drift_score) filter (level = 1), 1e-8), 3)
        as scale_decay_ratio from lv group by batch)"""


@query(
    "multiscale_drift",
    f"""{PYRAMID} select lv.*, scale_decay_ratio, case when scale_decay_ratio > 3 then '{im.FINE}' when scale_decay_ratio < 1.5 then '{im.COARSE}'
        else '{im.MIDDLE}' end as interpretation from lv join pf using (batch)""",
)
def multiscale_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = im.multiscale(*sides(gray(spark, sf_dir)), "label")
    return levels.join(im.scale_profile(levels), "batch")


@query(
    "image_severity",
    """select event_id, case when value / 100 >= 0.25 then 'high' when value / 100 >= 0.1 then 'medium' else 'low' end as severity,
        value / 100 >= 0.1 as detected from events""",
)
def image_severity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", image_severity(F.col("value") / 100).alias("severity"))
    return rows.withColumn("detected", F.col("severity") != "low")


MMD_SQL = """with e as (select vec_id, embedding::double[] as v, label < 5 as r from embeddings),
    d as (select a.r::int + b.r::int as kind, list_distance(a.v, b.v) ** 2 as d2 from e a join e b on a.vec_id < b.vec_id),
    g as (select 1 / (median(d2) + 1e-8) as gamma from d where d2 > 0),
    k as (select kind, sum(exp(-gamma * d2)) as s from d, g group by kind),
    c as (select count(*) filter (r) as n, count(*) filter (not r) as m from e)
    select round(greatest(0, 2 * max(s) filter (kind = 2) / (max(n) * (max(n) - 1)) + 2 * max(s) filter (kind = 0) / (max(m) * (max(m) - 1))
        - 2 * max(s) filter (kind = 1) / (max(n) * max(m))), 8) + 0.0 as mmd, round(max(gamma), 6) as gamma, max(n) as n, max(m) as m
    from k, c, g"""


@query("embedding_mmd", MMD_SQL)
def embedding_mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, batch = sides(table(spark, sf_dir, "embeddings"))
    out = mmd.embedding_mmd(reference, batch, "embedding")
    return out.select(r6("mmd", 8).alias("mmd"), r6("gamma").alias("gamma"), "n", "m")


@query("embedding_mmd_features")
def embedding_mmd_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, batch = sides(table(spark, sf_dir, "embeddings"))
    return mmd.mmd_features(reference, batch, "embedding", gamma=0.5)


SCORES = "select cast(user_id as varchar(20)) as batch, event_type as channel, avg(value) / 100 as drift_score from events group by 1, 2"
SIGNATURES = """select concat('day-', substr(cast(cast(ts as date) as varchar(10)), 9, 2)) as scenario, event_type as channel,
    avg(value) / 100 as drift_score from events group by 1, 2"""
REPORT = """select concat('day-', substr(cast(cast(ts as date) as varchar(10)), 9, 2)) as scenario, -count(*) / 10000.0 as delta_accuracy
    from events where event_type <> 'error' group by 1 having avg(value) > 20"""


@query(
    "scenario_match",
    f"""with s as ({SCORES}), g as ({SIGNATURES}), r as ({REPORT}),
    d as (select batch, scenario, sqrt(sum((s.drift_score - g.drift_score) ** 2)) as d from s join g using (channel) group by all),
    b as (select batch, min(d) as d, arg_min(scenario, (d, scenario)) as scenario from d group by batch)
    select batch, b.scenario as matched_scenario, round(d, 6) as match_distance,
        case when d < 0.05 then 'high' when d < 0.1 then 'medium' else 'low' end as confidence,
        round(delta_accuracy::double, 6) as estimated_accuracy_drop from b left join r using (scenario) where d <= 0.2""",
)
def scenario_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, signatures = derived(spark, sf_dir, SCORES), derived(spark, sf_dir, SIGNATURES)
    out = im.match_scenarios(scores, signatures, derived(spark, sf_dir, REPORT))
    return out.withColumn("estimated_accuracy_drop", r6("estimated_accuracy_drop"))


def image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, batches = sides(gray(spark, sf_dir))
    bright = reference.withColumn("pixels", F.transform("pixels", lambda x: x + 0.1)).withColumn("label", F.lit("bright"))
    signatures = im.channel_wasserstein(reference, bright, "label").withColumnRenamed("batch", "scenario")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return monitor_images(reference, batches, "label", signatures=signatures, generated_at=at)


@query(
    "monitor_image_batch",
    f"""{PYRAMID}, s as (select batch, statistic as score from ws where feature = '0/gray'),
    k as (select label::varchar as batch, count(*) as size from embeddings where label >= 5 group by 1)
    select s.batch, 'image_statistical' as drift_type, size, (select count(*) from embeddings where label < 5) as reference_size,
        round(score, 6) as drift_score, case when score >= 0.25 then 'high' when score >= 0.1 then 'medium' else 'low' end as severity,
        score >= 0.1 as dataset_drift_detected, round(score, 6) as gray_score, scale_decay_ratio,
        case when abs(score - 0.1) <= 0.2 then 'bright' end as matched_scenario,
        case when abs(score - 0.1) <= 0.2 then round(abs(score - 0.1), 4) end as match_distance
    from s join k using (batch) join pf using (batch) where size >= 10""",
)
def monitor_image_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = image_records(spark, sf_dir)
    return r.select(
        "batch",
        "drift_type",
        F.col("batch_info.size").alias("size"),
        F.col("reference.size").alias("reference_size"),
        r6("overall.drift_score").alias("drift_score"),
        "overall.severity",
        "overall.dataset_drift_detected",
        r6(F.col("channels")["gray"]["drift_score"]).alias("gray_score"),
        "multiscale_profile.scale_decay_ratio",
        "scenario_interpretation.matched_scenario",
        F.round("scenario_interpretation.match_distance", 4).alias("match_distance"),
    )


@query(
    "monitor_embedding_batch",
    f"""select 'labels 5-9' as batch, 'image_embedding' as drift_type, m as size, n as reference_size, round(mmd, 6) as drift_score,
        case when mmd >= 0.25 then 'high' when mmd >= 0.1 then 'medium' else 'low' end as severity from ({MMD_SQL}) where m >= 10""",
)
def monitor_embedding_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, batch = sides(table(spark, sf_dir, "embeddings"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    r = monitor_embeddings(reference, batch, "labels 5-9", "embedding", generated_at=at)
    return r.select(
        "batch",
        "drift_type",
        F.col("batch_info.size").alias("size"),
        F.col("reference.size").alias("reference_size"),
        r6("overall.drift_score").alias("drift_score"),
        "overall.severity",
    )
