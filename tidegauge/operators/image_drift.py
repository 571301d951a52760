"""Drift of image batches: distances per channel and scale, grades, and the nearest known scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import IMAGE_RECORD_VERSION, ImageDriftConfig
from tidegauge.functions.severity import image_severity
from tidegauge.operators import two_sample as ts
from tidegauge.operators.ordered import thinned
from tidegauge.operators.pixels import pyramid
from tidegauge.session import MAX_BUCKETS

# fixed values: the readings of a scale profile and the ratios between them
FINE_ABOVE, COARSE_BELOW = 3.0, 1.5
FINE = (
    "fine-detail drift — the distribution shift is concentrated in high-frequency content (likely: sensor noise floor "
    "change, sharpening parameter shift, or JPEG / compression artefacts)"
)
COARSE = (
    "global/coarse drift — the distribution shift persists at all spatial scales (likely: brightness change, colour cast, "
    "or overall illumination / exposure shift)"
)
MIDDLE = (
    "mid-scale drift — the distribution shift is concentrated in intermediate spatial frequencies (likely: texture change "
    "or scene content shift)"
)


def channel_name() -> Column:
    """gray for one channel; r, g, b for the first three of more; the rest is not compared. Two channels are an error."""
    position = F.col("pos") % F.col("channels")
    colour = F.get(F.array(F.lit("r"), F.lit("g"), F.lit("b")), position)
    bad = F.raise_error(F.lit("images need one channel, or three and more"))
    return F.when(F.col("channels") == 1, "gray").when(F.col("channels") >= 3, colour).otherwise(bad.cast("string"))


def _long(images: DataFrame, batch: Column, prefix: Column | None) -> DataFrame:
    keep = [F.col("channels"), batch.cast("string").alias(ts.BATCH), F.posexplode("pixels").alias("pos", ts.VALUE)]
    if prefix is not None:
        keep.append(prefix.alias("_prefix"))
    rows = images.select(*keep).withColumn("_channel", channel_name()).where(F.col("_channel").isNotNull())
    name = F.col("_channel") if prefix is None else F.concat_ws("/", "_prefix", "_channel")
    return rows.where(F.col(ts.VALUE).isNotNull()).select(name.alias(ts.FEATURE), ts.BATCH, ts.VALUE)


PIXELS_PER_BUCKET = 50_000  # many small buckets, so that those which fall to one task add up to an even share
PIXELS_PER_TASK = 250_000  # a pixel takes about 1 kB in the windows of a task


def _pixel_buckets(*images: DataFrame) -> int:
    """How many ordered buckets the pixels need. They are counted: an image is one small row of its file, and as rows its
    pixels take many times its bytes."""
    pixels = sum(df.agg(F.sum(F.size("pixels").cast("bigint"))).first()[0] or 0 for df in images)
    return max(1, min(MAX_BUCKETS, -(-pixels // PIXELS_PER_BUCKET)))


def _tasks(spark: SparkSession, buckets: int, share: float) -> int | None:
    """Over how many tasks the pixels go, ``share`` times those counted; None where the session has as many."""
    wanted = int(buckets * share * PIXELS_PER_BUCKET) // PIXELS_PER_TASK
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions", "200")) else None


def _distances(
    reference: DataFrame, batches: DataFrame, batch: str, number: int, prefix: Column | None = None, share: float = 1.0
) -> DataFrame:
    def both(ref: DataFrame, cur: DataFrame) -> DataFrame:
        return _long(ref, F.lit(None), prefix).unionByName(_long(cur.where(F.col(batch).isNotNull()), F.col(batch), prefix))

    thin = None if number <= 1 else both(thinned(reference), thinned(batches))
    tasks = _tasks(reference.sparkSession, number, share)
    return ts.wasserstein(
        ts.Samples(ts.counts_of(both(reference, batches)), thin, number, ts.salt_number(reference, batches), tasks)
    )


def channel_wasserstein(reference: DataFrame, batches: DataFrame, batch: str) -> DataFrame:
    """(batch, channel, drift_score): earth mover distance over all pixels of a channel, unscaled."""
    out = _distances(reference, batches, batch, _pixel_buckets(reference, batches))
    return out.select(ts.BATCH, F.col(ts.FEATURE).alias("channel"), F.col("statistic").alias("drift_score"))


def overall_score(channels: DataFrame) -> DataFrame:
    """(batch, drift_score): the mean of the channels."""
    return channels.groupBy(ts.BATCH).agg(F.avg("drift_score").alias("drift_score"))


def graded(scores: DataFrame, config: ImageDriftConfig = ImageDriftConfig()) -> DataFrame:
    severity = image_severity(F.col("drift_score"), config)
    return scores.withColumn("severity", severity).withColumn("dataset_drift_detected", F.col("severity") != "low")


def multiscale(reference: DataFrame, batches: DataFrame, batch: str, config: ImageDriftConfig = ImageDriftConfig()) -> DataFrame:
    """(batch, level, channel, drift_score) at every pyramid level both sides have; scores rounded to 6."""
    keep = ["pixels", "height", "width", "channels"]
    args = (config.pyramid_levels, config.pyramid_sigma, config.pyramid_min_side)
    ref = pyramid(reference.select(*keep), *args)
    cur = pyramid(batches.select(F.col(batch).cast("string").alias(ts.BATCH), *keep), *args)
    # the finest level has all the pixels, the others fewer and buckets of their own
    out = _distances(ref, cur, ts.BATCH, _pixel_buckets(reference, batches), F.col("level").cast("string"), 4 / 3)
    parts = F.split(F.col(ts.FEATURE), "/")
    return out.select(
        ts.BATCH, parts[0].cast("int").alias("level"), parts[1].alias("channel"), F.round("statistic", 6).alias("drift_score")
    )


def scale_profile(levels: DataFrame) -> DataFrame:
    """(batch, scale_decay_ratio, interpretation): finest over coarsest level, and what that suggests."""
    per_level = levels.groupBy(ts.BATCH, "level").agg(F.round(F.avg("drift_score"), 6).alias("score"))
    ends = per_level.groupBy(ts.BATCH).agg(F.min_by("score", "level").alias("fine"), F.max_by("score", "level").alias("coarse"))
    out = ends.withColumn("scale_decay_ratio", F.bround(F.col("fine") / F.greatest(F.col("coarse"), F.lit(1e-8)), 3))
    ratio = F.col("scale_decay_ratio")
    text = F.when(ratio > FINE_ABOVE, FINE).when(ratio < COARSE_BELOW, COARSE).otherwise(MIDDLE)
    return out.select(ts.BATCH, "scale_decay_ratio", text.alias("interpretation"))


SIGNATURE_ENTRIES = 50_000  # scores of signatures that are held by every task at once


def _signature_blocks(signatures: DataFrame) -> tuple[DataFrame, int]:
    """(block, names, vectors): the scenarios of a block as one row, each with its scores in the order of ``names``,
    the channels of the block. A count decides the number of blocks, so a block stays near SIGNATURE_ENTRIES scores."""
    known = signatures.where("scenario is not null and channel is not null and drift_score is not null")
    scores = known.groupBy("scenario", "channel").agg(F.avg("drift_score").alias("s"))
    blocks = max(1, -(-scores.count() // SIGNATURE_ENTRIES))
    own = scores.groupBy("scenario").agg(F.map_from_entries(F.collect_list(F.struct("channel", "s"))).alias("m"))
    block = F.pmod(F.xxhash64("scenario"), F.lit(blocks)).cast("int").alias("block")
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("m")))))
    packed = own.groupBy(block).agg(names.alias("names"), F.collect_list(F.struct("scenario", "m")).alias("all"))
    vector = F.transform("all", lambda x: F.struct(x["scenario"], F.transform("names", lambda c: x["m"][c]).alias("v")))
    return packed.select("block", "names", vector.alias("vectors")), blocks


def _nearest() -> tuple[Column, Column]:
    """The scores whose channels ``names`` has, with their places in it (to be stored as ``_found``), and the smallest
    (distance, scenario) of ``vectors`` to them, null where no channel is shared."""
    at = F.transform("scores", lambda x: F.struct((F.array_position("names", x["channel"]) - 1).cast("int").alias("i"), x["drift_score"]))
    found = F.filter(at, lambda x: x["i"] >= 0)

    def distance(v: Column) -> Column:
        squares = F.filter(F.transform("_found", lambda x: F.pow(x["drift_score"] - F.get(v, x["i"]), F.lit(2.0))), F.isnotnull)
        total = F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(squares) > 0, F.sqrt(total))

    candidates = F.transform("vectors", lambda x: F.struct(distance(x["v"]).alias("d"), x["scenario"].alias("scenario")))
    return found, F.array_min(F.filter(candidates, lambda x: x["d"].isNotNull()))


def match_scenarios(
    scores: DataFrame, signatures: DataFrame, report: DataFrame | None = None, config: ImageDriftConfig = ImageDriftConfig()
) -> DataFrame:
    """(batch, matched_scenario, match_distance, confidence, estimated_accuracy_drop): the nearest signature.

    ``scores`` is (batch, channel, drift_score), ``signatures`` (scenario, channel, drift_score). Distances run
    over the channels both have a score for; scenarios without such a channel are no match, the rest ties to the
    smaller name. Repeated rows of a batch's channel all count, repeated rows of a signature's count as their mean.
    A batch whose nearest scenario is beyond the limit has no row.

    A batch is one row with all its scores and meets the signatures as vectors, so nothing is shuffled on a channel
    and no (batch, scenario) row is made. Signatures of up to SIGNATURE_ENTRIES scores (counted) go to every task;
    more are met block by block, over as many salts as the session has shuffle partitions.
    """
    blocks, number = _signature_blocks(signatures)
    own = scores.where(F.col(ts.BATCH).isNotNull() & F.col("channel").isNotNull() & F.col("drift_score").isNotNull())
    rows = own.groupBy(ts.BATCH).agg(F.array_sort(F.collect_list(F.struct("channel", "drift_score"))).alias("scores"))
    if number == 1:
        all_of_it = blocks.agg(F.first(F.struct("names", "vectors"))).scalar()
        met = rows.withColumn("_b", all_of_it).select(ts.BATCH, "scores", "_b.names", "_b.vectors").where("names is not null")
    else:
        salts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        each = F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
        spread = rows.withColumn("block", each).withColumn("salt", F.pmod(F.xxhash64(ts.BATCH), F.lit(salts)).cast("int"))
        copies = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = spread.join(copies, ["block", "salt"])
    found, nearest = _nearest()
    near = met.withColumn("_found", found).select(ts.BATCH, nearest.alias("b"))
    best = near if number == 1 else near.groupBy(ts.BATCH).agg(F.min(F.when(F.col("b").isNotNull(), F.col("b"))).alias("b"))
    d = F.col("b.d")
    confidence = F.when(d < config.match_high, "high").when(d < config.match_medium, "medium").otherwise("low")
    out = best.where(d <= config.match_limit).select(
        ts.BATCH, F.col("b.scenario").alias("matched_scenario"), F.round(d, 6).alias("match_distance"), confidence.alias("confidence")
    )
    if report is None:
        return out.withColumn("estimated_accuracy_drop", F.lit(None).cast("double"))
    drops = report.select(F.col("scenario").alias("matched_scenario"), F.col("delta_accuracy").alias("estimated_accuracy_drop"))
    return out.join(drops, "matched_scenario", "left")


def channel_summary(channels: DataFrame, config: ImageDriftConfig = ImageDriftConfig()) -> DataFrame:
    """(batch, drift_score, channels): the mean of the channels, and each channel's score and grade."""
    grade = F.struct(
        F.round("drift_score", 6).alias("drift_score"), image_severity(F.col("drift_score"), config).alias("severity")
    )
    return channels.groupBy(ts.BATCH).agg(
        F.avg("drift_score").alias("drift_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", grade)))).alias("channels"),
    )


_RECORD_PARTS = {
    "scale_decay_ratio": "double",
    "interpretation": "string",
    "scenario_interpretation": "string",
    "channels": "map<string,struct<drift_score:double,severity:string>>",
}


def image_records(
    rows: DataFrame,
    reference_size: Column,
    method: str,
    task_type: str = "image_classification_cnn",
    generated_at: Column | None = None,
    config: ImageDriftConfig = ImageDriftConfig(),
) -> DataFrame:
    """One nested record per row (batch, drift_score, row_count, and any of the parts a method has)."""
    absent = {c: F.lit(None).cast(t) for c, t in _RECORD_PARTS.items() if c not in rows.columns}
    return graded(rows, config).withColumns(absent).select(
        ts.BATCH,
        F.lit(IMAGE_RECORD_VERSION).alias("schema_version"),
        F.lit(f"image_{method}").alias("drift_type"),
        F.lit(method).alias("method"),
        (generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"),
        F.lit(task_type).alias("task_type"),
        F.struct(reference_size.alias("size"), F.lit("train").alias("source")).alias("reference"),
        F.struct(F.col("row_count").alias("size")).alias("batch_info"),
        F.struct(F.round("drift_score", 6).alias("drift_score"), "dataset_drift_detected", "severity").alias("overall"),
        "scenario_interpretation",
        F.struct("scale_decay_ratio", "interpretation").alias("multiscale_profile"),
        "channels",
    )
