import hashlib
import zlib

import numpy as np
import pytest

from tidegauge.llm import progressive_jpeg as jpeg
from tidegauge.llm.media import padded, read_media, with_media
from tidegauge.llm.query_media import op1_progressive_jpeg


def java_image(spark, data):
    """The JVM's own decoder: raw component rows without colour conversion, and RGB."""
    jvm = spark._jvm
    stream = lambda: jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(stream())
    raster = reader.readRaster(0, None)
    w, h, n = raster.getWidth(), raster.getHeight(), raster.getNumBands()
    planes = raster.getDataElements(0, 0, w, h, None)
    planes = np.frombuffer(bytes(planes), np.uint8).reshape(h, w, n)
    return planes


def java_jpeg(spark, image):
    """A progressive JPEG with optimised tables and subsampled chroma from the JVM's encoder."""
    jvm, h, w = spark._jvm, *image.shape[:2]
    buffered = jvm.java.awt.image.BufferedImage(w, h, 1)
    flat = (image[..., 0].astype(int) << 16 | image[..., 1].astype(int) << 8 | image[..., 2]).ravel().tolist()
    array = spark.sparkContext._gateway.new_array(jvm.int, len(flat))
    for i, x in enumerate(flat):
        array[i] = x
    buffered.setRGB(0, 0, w, h, array, 0, w)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1)  # the scans of the writer's default progression
    out = jvm.java.io.ByteArrayOutputStream()
    target = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(target)
    writer.write(None, jvm.javax.imageio.IIOImage(buffered, None, None), how)
    target.flush()
    return bytes(out.toByteArray())


def decode(data):
    image = jpeg.parse(data)
    return image, jpeg.coefficients([image])


@pytest.mark.parametrize("size", [64, 128, 384, 448, 64 * 6 * 64, 64 * 6 * 64 * 3 + 64])
def test_payloads_come_back(size):
    rng = np.random.default_rng(size)
    for body in (rng.integers(0, 256, size).astype(np.uint8).tobytes(), bytes(size), b"\xff" * size, b"\x80\x7f" * (size // 2)):
        image, found = decode(jpeg.encode(body))
        assert jpeg.payload(image, found) == body
        assert len(image.scans) == 11 and {(s.first, s.last, s.high, s.low) for s in image.scans} == {
            (0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (1, 63, 1, 0), (0, 0, 1, 0)}


def test_images_decoded_together_are_as_alone():
    rng = np.random.default_rng(1)
    bodies = [rng.integers(0, 256, 64 * n).astype(np.uint8).tobytes() for n in (1, 50, 7, 400)]
    images = [jpeg.parse(jpeg.encode(b)) for b in bodies]
    found = jpeg.coefficients(images)
    for body, image in zip(bodies, images):
        alone, own = decode(jpeg.encode(body))
        assert (jpeg.rgb(image, found) == jpeg.rgb(alone, own)).all()
        assert jpeg.payload(image, found) == body


def test_long_payload_needs_several_runs_of_blocks():
    body = bytes(range(256)) * (64 * 6 * 6000 // 256)
    image, found = decode(jpeg.encode(body))
    assert jpeg.payload(image, found) == body


def test_another_decoder_reads_our_luma(spark):
    body = padded(b"The quick brown fox jumps over the lazy dog. " * 60)
    data = jpeg.encode(body)
    image, found = decode(data)
    planes = java_image(spark, data)
    luma = image.components[0]
    own = jpeg.samples(found[: luma.across * luma.down]).reshape(luma.down, luma.across, 8, 8).transpose(0, 2, 1, 3)
    assert planes.shape == (image.height, image.width, 3)
    assert np.abs(own.reshape(image.height, image.width) - planes[..., 0].astype(int)).max() <= 1


@pytest.mark.parametrize("shape", [(64, 64), (37, 53), (8, 200)])
def test_we_read_another_encoder(spark, shape):
    """Its scans have Huffman tables, zero runs, block runs, refinements with new coefficients and odd sizes."""
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    rng = np.random.default_rng(5)
    smooth = np.stack((128 + 90 * np.sin(x / 17 + y / 29), 128 + 80 * np.cos(y / 23), 100 + x * 100 / shape[1]), axis=2)
    rough = smooth + rng.normal(size=(*shape, 1)) * 20  # in luma only
    data = java_jpeg(spark, np.clip(rough, 0, 255).astype(np.uint8))
    image, found = decode(data)
    assert any(s.high for s in image.scans) and (image.height, image.width) == shape
    planes = java_image(spark, data).astype(int)
    got = jpeg.rgb(image, found).astype(int)
    blue, red = planes[..., 1] - 128, planes[..., 2] - 128
    want = np.stack((planes[..., 0] + 1.402 * red, planes[..., 0] - 0.344136 * blue - 0.714136 * red, planes[..., 0] + 1.772 * blue), axis=2)
    off = np.abs(got - np.clip(want, 0, 255))
    assert off.mean() < 3 and np.percentile(off, 99) < 14  # chroma is replicated here and smoothed there


def test_messy(messy, messy_rows, nothing):
    rows = read_media(with_media(messy)).collect()
    want = sorted((str(r[0]), padded((r[1] or "").encode()), len((r[1] or "").encode())) for r in messy_rows)
    assert sorted((str(r["doc_id"]), bytes(r["payload"]), r["n_bytes"]) for r in rows) == want
    for r in rows:
        assert len(r["rgb"]) == r["height"] * r["width"] * 3
        assert np.frombuffer(r["rgb"], np.uint8).reshape(-1, 3).sum(axis=0).tolist() == r["sums"]
    assert read_media(with_media(nothing)).collect() == []


def test_query(spark, sf_dir, small):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in small.collect()}
    rows, seen = op1_progressive_jpeg(spark, sf_dir).collect(), {}
    assert len(rows) == len(texts)
    for r in rows:
        body = texts[r["doc_id"]]
        whole = padded(body)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(body), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(whole[-64:])
        media = jpeg.encode(whole)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert seen.setdefault(body, r["feature"]) == r["feature"]
    assert len(set(seen.values())) == len(seen)


def test_broken_files_are_refused():
    data = jpeg.encode(bytes(640))
    for bad in (b"", data[:-2], data[:200], b"\xff\xd8\xff\xd9"[:3]):
        with pytest.raises((jpeg.BadJpeg, IndexError)):
            jpeg.coefficients([jpeg.parse(bad)])
