"""Texts as media: a column of progressive JPEGs, and the tensors read back from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import progressive_jpeg as jpeg
from .common import chunks, raw

PAD = 64


def padded(text: bytes | None) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    body = text or b""
    return body + bytes(max(PAD, -(-len(body) // PAD) * PAD) - len(body))


def with_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, in a progressive JPEG's coefficients.

    A null text is empty. Equal texts give equal media. Other columns are ignored; no rows give no rows; no row moves.
    """
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    source = df.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            bodies = raw(rows.column(1))
            sizes = pa.array([len(b or b"") for b in bodies], pa.int64())
            media = pa.array([jpeg.encode(padded(b)) for b in bodies], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), sizes, media], names=["doc_id", "n_bytes", "media"])

    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """``df``'s doc_id, n_bytes and media with what the JPEG holds: payload, height, width, rgb and the channels' sums.

    ``rgb`` is the full-resolution tensor, height x width x 3 bytes. Transform and colours are whole-number arithmetic,
    so equal media give equal tensors whatever else is decoded with them.
    """
    source = df.select("doc_id", "n_bytes", F.col(media).alias("media"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, "media"):
            images = [jpeg.parse(m) for m in raw(rows.column(2))]
            found = jpeg.coefficients(images)
            tensors = jpeg.tensors(images, found)
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    pa.array([jpeg.payload(image, found) for image in images], pa.binary()),
                    pa.array([i.height for i in images], pa.int32()),
                    pa.array([i.width for i in images], pa.int32()),
                    pa.array([t.tobytes() for t in tensors], pa.binary()),
                    pa.array([t.sum(axis=(0, 1), dtype=np.int64) for t in tensors], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_bytes", "media", "payload", "height", "width", "rgb", "sums"],
            )

    shape = f"doc_id {kind}, n_bytes long, media binary, payload binary, height int, width int, rgb binary, sums array<long>"
    return source.mapInArrow(run, shape)
