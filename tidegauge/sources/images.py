"""Image folders: listings from file metadata, and decoding by Spark's own image source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: extensions that count as images
EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
IMAGE_SCHEMA = "path string, height int, width int, channels int, pixels array<double>"


def _extension():
    return F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified_at) of every file below ``root``; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified_at"))


def image_folder_scan(spark: SparkSession, root: str, formats: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, label, length): images in class folders right below ``root``; the folder is the label."""
    in_class = F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 2)
    parent = F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 1)
    listing = file_listing(spark, root).where(_extension().isin(*[f.lower() for f in formats]))
    return listing.where(parent == root.rstrip("/").split("/")[-1]).select("path", in_class.alias("label"), "length")


def flat_scan(spark: SparkSession, root: str, formats: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length): images anywhere below ``root``, without classes."""
    return file_listing(spark, root).where(_extension().isin(*[f.lower() for f in formats])).select("path", "length")


def image_manifest(listing: DataFrame) -> DataFrame:
    """(file_path, label) of a listing."""
    return listing.select(F.col("path").alias("file_path"), "label")


def labelled_scan(spark: SparkSession, root: str, formats: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The listing of a labelled batch; a flat folder and an empty one have their own errors."""
    listing = image_folder_scan(spark, root, formats)
    if listing.isEmpty():
        loose = flat_scan(spark, root, formats).count()
        if loose:
            raise ValueError(f"{loose} images lie in {root}, but in no class folder")
        raise ValueError(f"no labelled images in {root}")
    return listing


def class_sizes(listing: DataFrame) -> DataFrame:
    return listing.groupBy("label").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def image_load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(images, unreadable): decoded images as pixel arrays in RGB order, and the paths that do not decode."""
    raw = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
    flat = raw.select(
        F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"
    )
    unreadable = flat.where("height <= 0").select("path")

    def to_pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                image = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.channels)
                if r.channels >= 3:
                    image = image[:, :, 2::-1]  # the decoder stores blue first; alpha is dropped
                out.append((r.path, r.height, r.width, image.shape[2], image.astype(np.float64).ravel()))
            yield pd.DataFrame(out, columns=["path", "height", "width", "channels", "pixels"])

    return flat.where("height > 0").mapInPandas(to_pixels, IMAGE_SCHEMA), unreadable
