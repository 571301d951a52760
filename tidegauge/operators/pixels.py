"""Operators on pixel-array tables: one row per image, pixels flat in (row, column, channel) order.

Everything but blur and resize is an expression over the array, so images stay in the JVM; those two run as numpy
products over all images of a shape in an Arrow batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.columns import hash_fraction, seeded_hash

# fixed values: BT.601 luma weights
LUMA = (0.299, 0.587, 0.114)
GEOMETRY = ("height", "width", "channels")


def as_images(df: DataFrame, pixels: str, height: int, width: int, channels: int) -> DataFrame:
    """Give a table of flat arrays the columns of an image table."""
    shape = {"height": F.lit(height), "width": F.lit(width), "channels": F.lit(channels)}
    return df.withColumn("pixels", F.col(pixels).cast("array<double>")).withColumns(shape)


def pixel_scale(pixels: Column) -> Column:
    return F.transform(pixels, lambda x: x / F.lit(255.0))


def pixel_grayscale(df: DataFrame) -> DataFrame:
    """Colour images to one luma channel; images of one channel stay as they are."""
    spots = F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)
    p, c = F.col("pixels"), F.col("channels")
    luma = F.transform(spots, lambda i: sum((F.get(p, i * c + k) * w for k, w in enumerate(LUMA)), F.lit(0.0)))
    return df.withColumns({"pixels": F.when(c >= 3, luma).otherwise(p), "channels": F.lit(1)})


def pixel_flatten(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, pixel, value): one row per array element."""
    return df.select(*keys, F.posexplode("pixels").alias("pixel", "value"))


def channel_stats(df: DataFrame) -> DataFrame:
    """(channel, mean, std): over all pixels of all images; population deviation, 0 counts as 1."""
    long = df.select("channels", F.posexplode("pixels").alias("pos", "value"))
    out = long.groupBy((F.col("pos") % F.col("channels")).alias("channel")).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")
    )
    return out.select("channel", "mean", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("std"))


def channel_normalize(df: DataFrame, stats: DataFrame) -> DataFrame:
    """z-score every pixel with the stored statistics of its channel (one row per channel)."""
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("channel", "mean", "std")))).scalar()
    with_stats = df.withColumn("_s", packed)

    def z(x: Column, i: Column) -> Column:
        s = F.get(F.col("_s"), i % F.col("channels"))
        return (x - s["mean"]) / s["std"]

    return with_stats.withColumn("pixels", F.transform("pixels", z)).drop("_s")


# --- geometry as index maps -----------------------------------------------------------------------------


def _remapped(source_row, source_col) -> Column:
    """The image whose pixel (row, col) is read from (source_row, source_col) of the old one."""
    w, c, p = F.col("width"), F.col("channels"), F.col("pixels")

    def at(i: Column) -> Column:
        spot, channel = F.floor(i / c), i % c
        row, col = F.floor(spot / w), spot % w
        return F.get(p, ((source_row(row, col) * w + source_col(row, col)) * c + channel).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), at)


def flip_horizontal() -> Column:
    return _remapped(lambda r, c: r, lambda r, c: F.col("width") - 1 - c)


def rotate(quarter_turns: Column | int) -> Column:
    """Counter-clockwise quarter turns of square images; half turns work on any image."""
    k = F.lit(quarter_turns) if isinstance(quarter_turns, int) else quarter_turns
    last_row, last_col = F.col("height") - 1, F.col("width") - 1
    return _remapped(
        lambda r, c: F.when(k == 1, c).when(k == 2, last_row - r).when(k == 3, last_col - c).otherwise(r),
        lambda r, c: F.when(k == 1, last_row - r).when(k == 2, last_col - c).when(k == 3, r).otherwise(c),
    )


def crop_shifted(padding: int, top: Column, left: Column) -> Column:
    """Pad by mirroring without repeating the edge, then cut the window at (top, left)."""

    def mirrored(i: Column, size: Column) -> Column:
        i = F.abs(i)
        return F.when(i >= size, 2 * (size - 1) - i).otherwise(i)

    return _remapped(
        lambda r, c: mirrored(r + top - padding, F.col("height")), lambda r, c: mirrored(c + left - padding, F.col("width"))
    )


# --- augmentation ---------------------------------------------------------------------------------------


def augment_replicas(df: DataFrame, key: str, factor: int) -> DataFrame:
    """The originals (copy_no 0) and ``factor - 1`` copies of each row, all other columns kept."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(max(factor, 1) - 1))))


def _draw(seed: int, key: str, what: str) -> Column:
    """A uniform number that depends on the row's key, its copy and the purpose only."""
    return hash_fraction(seeded_hash(f"{seed}:{what}", F.col(key), F.col("copy_no")))


def augment_geometric(df: DataFrame, key: str, seed: int, flip: bool = True, rotation: bool = True, padding: int = 0) -> DataFrame:
    """Random crop, flip and quarter turns of the copies; originals stay untouched."""
    is_copy = F.col("copy_no") > 0
    out = df
    if padding > 0:
        top = F.floor(_draw(seed, key, "top") * (2 * padding + 1))
        left = F.floor(_draw(seed, key, "left") * (2 * padding + 1))
        out = out.withColumn("pixels", F.when(is_copy, crop_shifted(padding, top, left)).otherwise(F.col("pixels")))
    if flip:
        out = out.withColumn("pixels", F.when(is_copy & (_draw(seed, key, "flip") > 0.5), flip_horizontal()).otherwise(F.col("pixels")))
    if rotation:
        out = out.withColumn("_k", F.when(is_copy, F.floor(_draw(seed, key, "turn") * 4)).otherwise(0))
        out = out.withColumn("pixels", F.when(F.col("_k") > 0, rotate(F.col("_k"))).otherwise(F.col("pixels"))).drop("_k")
    return out


def augment_photometric(
    df: DataFrame, key: str, seed: int, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0
) -> DataFrame:
    """Random brightness, contrast around the image mean and saturation toward luma, clipped to [0, 1]."""

    def factor(size: float, what: str) -> Column:
        low = max(0.0, 1.0 - size)
        return F.lit(low) + _draw(seed, key, what) * F.lit(1.0 + size - low)

    p = F.col("pixels")
    out = df.withColumn("_p", p)
    if brightness > 0:
        f = factor(brightness, "brightness")
        out = out.withColumn("_f", f).withColumn("_p", F.transform("_p", lambda x: x * F.col("_f")))
    if contrast > 0:
        mean = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x) / F.size("_p")
        out = out.withColumns({"_f": factor(contrast, "contrast"), "_m": mean})
        out = out.withColumn("_p", F.transform("_p", lambda x: (x - F.col("_m")) * F.col("_f") + F.col("_m")))
    if saturation > 0:
        out = out.withColumn("_f", factor(saturation, "saturation"))
        c = F.col("channels")

        def blended(x: Column, i: Column) -> Column:
            base = i - i % c
            gray = sum((F.get(F.col("_p"), base + k) * w for k, w in enumerate(LUMA)), F.lit(0.0))
            return gray + (x - gray) * F.col("_f")

        out = out.withColumn("_p", F.when(c >= 3, F.transform("_p", blended)).otherwise(F.col("_p")))
    clipped = F.transform("_p", lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("pixels", F.when(F.col("copy_no") > 0, clipped).otherwise(p)).drop("_p", "_f", "_m")


# --- banded products over stacks of images --------------------------------------------------------------
#
# Blur and resampling are linear along each side: every new row (column) is a short weighted sum of old ones. A
# band holds, for each new position, the old positions it reads and their weights, so that a side costs one pass
# per tap over all images of a shape at once.

Band = tuple[np.ndarray, np.ndarray]  # positions and weights, both (new size, taps)
STACK_VALUES = 1 << 22  # numbers of one stack, so that a task's memory does not grow with Arrow's batches


def gaussian_kernel(sigma: float) -> np.ndarray:
    radius = int(4.0 * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2)
    return k / k.sum()


def blur_band(size: int, sigma: float, step: int = 1) -> Band:
    """Gaussian blur of every ``step``-th position; edges are mirrored with the edge pixel repeated."""
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    at = (np.arange(0, size, step)[:, None] + np.arange(-radius, radius + 1)) % (2 * size)
    return np.where(at < size, at, 2 * size - 1 - at), np.broadcast_to(kernel, at.shape)


def resize_band(size: int, wanted: int) -> Band:
    """Bilinear resampling with pixel centres aligned."""
    at = np.clip((np.arange(wanted) + 0.5) * size / wanted - 0.5, 0, size - 1)
    low = np.floor(at).astype(int)
    part = at - low
    return np.stack([low, np.minimum(low + 1, size - 1)], axis=1), np.stack([1 - part, part], axis=1)


def banded(stack: np.ndarray, axis: int, band: Band) -> np.ndarray:
    """The product of a band with one side of a stack (images, rows, columns, channels)."""
    positions, weights = band
    shape = [1] * stack.ndim
    shape[axis] = -1
    out = np.take(stack, positions[:, 0], axis=axis) * weights[:, 0].reshape(shape)
    for tap in range(1, positions.shape[1]):
        out += np.take(stack, positions[:, tap], axis=axis) * weights[:, tap].reshape(shape)
    return out


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
    """The rows of a batch by shape, each part with its images as one array; rows without pixels come with None."""
    names = batch.schema.names
    pixels = batch.column(names.index("pixels"))
    shape = np.stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in GEOMETRY], axis=1)
    shape[np.isnan(shape).any(axis=1) | ~pixels.is_valid().to_numpy(zero_copy_only=False)] = -1
    kinds, which = np.unique(shape, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(which.ravel(), minlength=len(kinds)))
    for kind, end, begin in zip(kinds.astype(int), ends, [0, *ends[:-1]]):
        size = int(np.prod(kind))
        step = len(order) if kind[0] < 0 else max(1, STACK_VALUES // max(size, 1))
        for at in range(begin, end, step):
            part = batch.take(pa.array(order[at : min(at + step, end)]))
            if kind[0] < 0:
                yield part, None
                continue
            lists = part.column(names.index("pixels"))
            lengths = lists.value_lengths().to_numpy()
            if (lengths != size).any():
                raise ValueError(f"an image of {' x '.join(map(str, kind))} has {lengths[lengths != size][0]} pixels")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield part, values.reshape(-1, *kind)


def _with_stack(part: pa.RecordBatch, schema: pa.Schema, stack: np.ndarray, **more: int) -> pa.RecordBatch:
    """The rows with new images; other columns pass through, ``more`` are numbers equal in all rows."""
    count = len(stack)
    each = int(np.prod(stack.shape[1:]))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * each, pa.int32()), pa.array(stack.ravel()))
    fresh = {"height": stack.shape[1], "width": stack.shape[2], **more}
    columns = []
    for field in schema:
        if field.name == "pixels":
            columns.append(lists.cast(field.type))
        elif field.name in fresh:
            columns.append(pa.array(np.full(count, fresh[field.name])).cast(field.type))
        else:
            columns.append(part.column(part.schema.names.index(field.name)))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _mapped(df: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Every image changed stack by stack; rows without pixels or shape stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, stack in _stacks(batch):
                yield part if stack is None else _with_stack(part, batch.schema, change(stack))

    return df.mapInArrow(run, df.schema)


def pixel_resize(df: DataFrame, height: int, width: int) -> DataFrame:
    """Resize every image; other columns pass through. Images without pixels or shape stay as they are, a null
    pixel counts as NaN."""

    def change(stack: np.ndarray) -> np.ndarray:
        return banded(banded(stack, 2, resize_band(stack.shape[2], width)), 1, resize_band(stack.shape[1], height))

    return _mapped(df, change)


def _blurred(stack: np.ndarray, sigma: float, step: int = 1) -> np.ndarray:
    return banded(banded(stack, 1, blur_band(stack.shape[1], sigma, step)), 2, blur_band(stack.shape[2], sigma, step))


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur of an (H, W, C) array."""
    return _blurred(image[None].astype(np.float64), sigma)[0]


def pixel_blur(df: DataFrame, sigma: float) -> DataFrame:
    return _mapped(df, lambda stack: _blurred(stack, sigma))


def pyramid(df: DataFrame, levels: int = 3, sigma: float = 0.5, min_side: int = 4) -> DataFrame:
    """Every image at each level of a Gaussian pyramid: blur, halve, stop before a side falls below the minimum.
    Only the pixels that halving keeps are computed. Images without pixels have no level."""
    schema = T.StructType([*df.schema.fields, T.StructField("level", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.schema.append(pa.field("level", pa.int32()))
            for part, stack in _stacks(batch):
                level = 0
                while stack is not None and level < levels:
                    yield _with_stack(part, wanted, stack, level=level)
                    level += 1
                    halved = [-(-side // 2) for side in stack.shape[1:3]]
                    stack = _blurred(stack, sigma, 2) if min(halved) >= min_side and level < levels else None

    return df.mapInArrow(run, schema)


# --- perturbation scenarios -----------------------------------------------------------------------------


def _noise(key: str, sigma: float, seed: int) -> Column:
    """Gaussian noise by Box-Muller from a hash of key, position and seed."""

    def noisy(x: Column, i: Column) -> Column:
        h = F.xxhash64(F.lit(seed), F.col(key), i)
        u = (F.pmod(h, F.lit(2**31)) + 0.5) / float(2**31)
        v = F.pmod(F.shiftright(h, 31), F.lit(2**31)) / float(2**31)
        return x + F.lit(sigma) * F.sqrt(-2.0 * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v)

    return F.transform("pixels", noisy)


# fixed values: scenario names and their sizes (on z-scored pixels); the notes are ours
SCENARIOS: dict[str, str] = {
    "horizontal_flip": "columns in reverse order",
    "rotation_90": "a quarter turn to the right",
    "rotation_180": "upside down",
    "brightness_high": "0.5 added to every pixel",
    "brightness_low": "0.5 taken from every pixel",
    "contrast_low": "every pixel halved",
    "gaussian_noise": "independent noise of deviation 0.1",
    "gaussian_blur": "smoothed over a pixel's width",
}
_EXPRESSIONS = {
    "horizontal_flip": lambda key, seed: flip_horizontal(),
    "rotation_90": lambda key, seed: rotate(3),
    "rotation_180": lambda key, seed: rotate(2),
    "brightness_high": lambda key, seed: F.transform("pixels", lambda x: x + 0.5),
    "brightness_low": lambda key, seed: F.transform("pixels", lambda x: x - 0.5),
    "contrast_low": lambda key, seed: F.transform("pixels", lambda x: x * 0.5),
    "gaussian_noise": lambda key, seed: _noise(key, 0.1, seed),
}


def register_perturbation(name: str, description: str, pixels) -> None:
    """Add a scenario: ``pixels(key, seed)`` is the expression of the new pixel array."""
    SCENARIOS[name] = description
    _EXPRESSIONS[name] = pixels


def perturb(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Every image under every scenario, in a column ``scenario``. The blur is the only step outside the JVM."""
    names = [n for n in SCENARIOS if n in _EXPRESSIONS]
    choice = F.lit(None).cast("array<double>")
    for name in reversed(names):
        choice = F.when(F.col("scenario") == name, _EXPRESSIONS[name](key, seed)).otherwise(choice)
    many = df.withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn("pixels", choice)
    if "gaussian_blur" in SCENARIOS and "gaussian_blur" not in _EXPRESSIONS:
        many = many.unionByName(pixel_blur(df, 1.0).withColumn("scenario", F.lit("gaussian_blur")))
    return many


def prepare_batch(df: DataFrame, stats: DataFrame, height: int, width: int, grayscale: bool = False) -> DataFrame:
    """A batch of decoded images (0–255) as the model wants it: resized, scaled and normalised with train statistics."""
    rows = pixel_resize(df, height, width).withColumn("pixels", pixel_scale(F.col("pixels")))
    return channel_normalize(pixel_grayscale(rows) if grayscale else rows, stats)
