import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.config import ImageDriftConfig
from tidegauge.functions.severity import image_severity
from tidegauge.operators import image_drift as im
from tidegauge.operators import mmd
from tidegauge.operators import pixels as px
from tidegauge.plans.monitor import monitor_embeddings, monitor_images
from tidegauge.sources import images as src


def write_png(path, array):
    """An 8-bit PNG of an (H, W) or (H, W, 3) array."""
    kind = 0 if array.ndim == 2 else 2
    raw = b"".join(b"\x00" + row.astype(np.uint8).tobytes() for row in array)

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    header = struct.pack(">IIBBBBB", array.shape[1], array.shape[0], 8, kind, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("set") / "images"
    rng = np.random.default_rng(5)
    for label in ("cats", "dogs"):
        for i in range(3):
            write_png(root / label / f"{label}_{i}.png", rng.integers(0, 256, (8, 8, 3)))
    (root / "cats" / "broken.png").write_bytes(b"no image")
    (root / "cats" / "notes.txt").write_text("x")
    return root


def test_scan_manifest_and_labels(spark, folder, tmp_path):
    listing = src.image_folder_scan(spark, str(folder))
    assert {r["label"]: r["n"] for r in src.class_sizes(listing).collect()} == {"cats": 4, "dogs": 3}
    assert src.image_manifest(listing).columns == ["file_path", "label"]
    assert src.image_folder_scan(spark, str(folder), (".jpg",)).count() == 0
    flat = tmp_path / "flat"
    write_png(flat / "a.png", np.zeros((4, 4)))
    with pytest.raises(ValueError, match="no class folder"):
        src.labelled_scan(spark, str(flat))
    (tmp_path / "empty" / "c").mkdir(parents=True)
    (tmp_path / "empty" / "c" / "n.txt").write_text("x")
    with pytest.raises(ValueError, match="no labelled images"):
        src.labelled_scan(spark, str(tmp_path / "empty"))


def test_decoding_keeps_rgb_order_and_lists_unreadable(spark, tmp_path):
    picture = np.zeros((2, 3, 3))
    picture[0, 1] = (10, 20, 30)
    write_png(tmp_path / "set" / "a" / "one.png", picture)
    write_png(tmp_path / "set" / "a" / "gray.png", np.full((2, 2), 7))
    (tmp_path / "set" / "a" / "bad.png").write_bytes(b"junk")
    images, unreadable = src.image_load(spark, str(tmp_path / "set"))
    got = {r["path"].split("/")[-1]: r for r in images.collect()}
    assert (got["one.png"]["height"], got["one.png"]["width"], got["one.png"]["channels"]) == (2, 3, 3)
    assert got["one.png"]["pixels"][3:6] == [10.0, 20.0, 30.0] and got["gray.png"]["pixels"] == [7.0] * 4
    assert [r["path"].split("/")[-1] for r in unreadable.collect()] == ["bad.png"]


def table(spark, arrays, **extra):
    rows = []
    for i, a in enumerate(arrays):
        shape = a.shape if a.ndim == 3 else (*a.shape, 1)
        rows.append({"id": i, "pixels": a.astype(float).ravel().tolist(), "height": shape[0], "width": shape[1], "channels": shape[2], **{k: v[i] for k, v in extra.items()}})
    return spark.createDataFrame(pd.DataFrame(rows))


def arrays(df, order=("id",)):
    return [np.array(r["pixels"]).reshape(r["height"], r["width"], r["channels"]) for r in df.orderBy(*order).collect()]


def test_geometry_equals_numpy(spark):
    a = np.arange(4 * 4 * 3).reshape(4, 4, 3)
    df = table(spark, [a])
    assert (arrays(df.withColumn("pixels", px.flip_horizontal()))[0] == a[:, ::-1]).all()
    for k in (1, 2, 3):
        assert (arrays(df.withColumn("pixels", px.rotate(k)))[0] == np.rot90(a, k)).all()
    padded = np.pad(a, ((2, 2), (2, 2), (0, 0)), mode="reflect")
    got = arrays(df.withColumn("pixels", px.crop_shifted(2, F.lit(4), F.lit(1))))[0]
    assert (got == padded[4:8, 1:5]).all()


def test_gray_scale_stats_and_normalise(spark):
    a, b = np.arange(12).reshape(2, 2, 3) / 11, np.ones((2, 2, 3))
    df = table(spark, [a, b])
    gray = arrays(px.pixel_grayscale(df))[0]
    assert gray[..., 0] == pytest.approx(a @ np.array([0.299, 0.587, 0.114]))
    both = np.stack([a, b])
    stats = {r["channel"]: (r["mean"], r["std"]) for r in px.channel_stats(df).collect()}
    for c in range(3):
        assert stats[c] == pytest.approx((both[..., c].mean(), both[..., c].std()))
    out = np.stack(arrays(px.channel_normalize(df, px.channel_stats(df))))
    assert out == pytest.approx((both - both.mean(axis=(0, 1, 2))) / both.std(axis=(0, 1, 2)))
    flat = px.channel_stats(table(spark, [np.ones((2, 2))])).first()
    assert (flat["mean"], flat["std"]) == (1.0, 1.0)


def test_resize(spark):
    a = np.array([[0.0, 1.0], [2.0, 3.0]])
    up = arrays(px.pixel_resize(table(spark, [a]), 4, 4))[0][..., 0]
    assert up[0, 0] == 0.0 and up[-1, -1] == 3.0 and up.mean() == pytest.approx(1.5)
    assert (arrays(px.pixel_resize(table(spark, [a]), 2, 2))[0][..., 0] == a).all()
    assert arrays(px.pixel_resize(table(spark, [np.full((6, 4), 2.5)]), 3, 5))[0] == pytest.approx(2.5)


def resampled(image, height, width):
    """Bilinear resampling pixel by pixel."""
    h, w = image.shape[:2]
    out = np.zeros((height, width, image.shape[2]))
    for i in range(height):
        for j in range(width):
            y, x = min(max((i + 0.5) * h / height - 0.5, 0), h - 1), min(max((j + 0.5) * w / width - 0.5, 0), w - 1)
            y0, x0 = int(y), int(x)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            top = image[y0, x0] * (1 - x + x0) + image[y0, x1] * (x - x0)
            low = image[y1, x0] * (1 - x + x0) + image[y1, x1] * (x - x0)
            out[i, j] = top * (1 - y + y0) + low * (y - y0)
    return out


@pytest.mark.parametrize("stack", [1, 1 << 22])
def test_stacks_of_mixed_shapes(spark, monkeypatch, stack):
    """Shapes mixed in one batch, images without pixels or shape, a null pixel, extra columns and empty tables."""
    monkeypatch.setattr(px, "STACK_VALUES", stack)
    rng = np.random.default_rng(3)
    shapes = [(5, 7, 3), (1, 1, 1), (5, 7, 3), (9, 2, 1), (1, 6, 3)]
    images = [rng.random(s) for s in shapes]
    rows = [(i, a.ravel().tolist(), *a.shape, f"n{i}", [i]) for i, a in enumerate(images)]
    rows += [(5, None, 4, 4, 1, None, None), (6, [1.0], None, 1, 1, "x", []), (7, [None, 2.0], 1, 2, 1, "y", None)]
    df = spark.createDataFrame(rows, "id int, pixels array<double>, height int, width int, channels int, level_ string, batch array<int>").coalesce(1)
    out = {r["id"]: r for r in px.pixel_resize(df, 4, 3).collect()}
    for i, a in enumerate(images):
        assert (out[i]["height"], out[i]["width"], out[i]["level_"], out[i]["batch"]) == (4, 3, f"n{i}", [i])
        assert np.array(out[i]["pixels"]) == pytest.approx(resampled(a, 4, 3).ravel(), abs=1e-12)
    assert out[5]["pixels"] is None and out[5]["height"] == 4 and out[6]["pixels"] == [1.0] and out[6]["height"] is None
    assert len(out[7]["pixels"]) == 12 and math.isnan(out[7]["pixels"][0]) and out[7]["pixels"][2] == 2.0
    levels = {(r["id"], r["level"]): r for r in px.pyramid(df, 3, 0.5, 2).collect()}
    assert {k for k in levels if k[0] < 5} == {(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1), (2, 2), (3, 0), (4, 0)}
    want = px.blur(px.blur(images[2], 0.5)[::2, ::2], 0.5)[::2, ::2]
    assert np.array(levels[2, 2]["pixels"]) == pytest.approx(want.ravel()) and (levels[2, 2]["height"], levels[2, 2]["width"]) == (2, 2)
    assert px.pixel_blur(df.limit(0), 1.0).count() == 0
    wrong = spark.createDataFrame([([1.0, 2.0], 3, 3, 1)], "pixels array<double>, height int, width int, channels int")
    with pytest.raises(Exception, match="3 x 3 x 1 has 2 pixels"):
        px.pixel_resize(wrong, 2, 2).collect()


def test_blur_mirrors_as_often_as_needed():
    rng = np.random.default_rng(1)
    for side in (1, 2, 3, 8):
        image = rng.random((side, side, 2))
        kernel = px.gaussian_kernel(1.3)
        radius = len(kernel) // 2
        padded = np.pad(image, ((radius, radius), (radius, radius), (0, 0)), mode="symmetric")
        want = sum(a * b * padded[i : i + side, j : j + side] for i, a in enumerate(kernel) for j, b in enumerate(kernel))
        assert px.blur(image, 1.3) == pytest.approx(want)


def test_augmentation_keeps_originals_labels_and_range(spark):
    rng = np.random.default_rng(2)
    df = table(spark, [rng.random((4, 4, 3)) for _ in range(6)], label=list("abcdef"), is_drifted=[True] + [False] * 5)
    copies = px.augment_replicas(df, "id", 3)
    assert copies.count() == 18 and copies.where("is_drifted").count() == 3
    assert px.augment_replicas(df, "id", 1).count() == 6
    geo = px.augment_geometric(copies, "id", 1, padding=1)
    photo = px.augment_photometric(copies, "id", 1, 0.5, 0.5, 0.5)
    for out in (geo, photo):
        first = arrays(out.where("copy_no = 0"))
        assert all((x == y).all() for x, y in zip(first, arrays(df)))
        assert out.columns == copies.columns
    assert any((x != y).any() for x, y in zip(arrays(geo.where("copy_no = 1")), arrays(df)))
    values = np.stack(arrays(photo.where("copy_no > 0"), ("id", "copy_no")))
    assert values.min() >= 0 and values.max() <= 1
    assert arrays(px.augment_photometric(copies.repartition(5), "id", 1, 0.5, 0.5, 0.5), ("id", "copy_no"))[4] == pytest.approx(arrays(photo, ("id", "copy_no"))[4])


def test_blur_kernel():
    point = np.zeros((7, 7, 1))
    point[3, 3] = 1.0
    out = px.blur(point, 0.5)
    k = px.gaussian_kernel(0.5)
    assert len(k) == 5 and k.sum() == pytest.approx(1.0) and out.sum() == pytest.approx(1.0)
    assert out[3, 3, 0] == pytest.approx(k[2] ** 2) and out[3, 4, 0] == pytest.approx(k[2] * k[3])
    assert px.blur(np.full((5, 5, 1), 2.0), 1.0) == pytest.approx(2.0)


def test_perturbations(spark):
    rng = np.random.default_rng(4)
    df = table(spark, [rng.normal(size=(8, 8)) for _ in range(20)])
    out = px.perturb(df, "id")
    assert out.groupBy("scenario").count().count() == len(px.SCENARIOS) and out.count() == 160
    noise = np.stack(arrays(out.where("scenario = 'gaussian_noise'"))) - np.stack(arrays(df))
    assert abs(noise.mean()) < 0.02 and noise.std() == pytest.approx(0.1, abs=0.01)
    assert len(np.unique(noise.round(9))) == noise.size
    turned = arrays(out.where("scenario = 'rotation_90'"))[0]
    assert (turned == np.rot90(arrays(df)[0], 3)).all()


def earth_mover(a, b):
    a, b = np.sort(a.ravel()), np.sort(b.ravel())
    x = np.sort(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(a, x[:-1], "right") / len(a) - np.searchsorted(b, x[:-1], "right") / len(b))
    return float(np.sum(gap * np.diff(x)))


def test_channel_distances_and_pyramid(spark):
    rng = np.random.default_rng(6)
    ref = [rng.random((16, 16, 3)) for _ in range(12)]
    cur = [x + np.array([0.3, 0.0, 0.1]) for x in ref]
    left, right = table(spark, ref), table(spark, cur, b=["m"] * 12)
    got = {r["channel"]: r["drift_score"] for r in im.channel_wasserstein(left, right, "b").collect()}
    assert got == pytest.approx({"r": 0.3, "g": 0.0, "b": 0.1}, abs=1e-9)
    levels = im.multiscale(left, right, "b").collect()
    assert {r["level"] for r in levels} == {0, 1, 2}  # 16, 8, 4
    blurred = [px.blur(x, 0.5)[::2, ::2] for x in ref], [px.blur(x, 0.5)[::2, ::2] for x in cur]
    want = earth_mover(np.stack(blurred[0])[..., 0], np.stack(blurred[1])[..., 0])
    assert {(r["level"], r["channel"]): r["drift_score"] for r in levels}[1, "r"] == pytest.approx(want, abs=1e-6)
    profile = im.scale_profile(im.multiscale(left, right, "b")).first()
    assert profile["interpretation"] == im.COARSE and profile["scale_decay_ratio"] == pytest.approx(1.0, abs=0.01)
    noisy = [x + rng.normal(0, 0.5, x.shape) for x in ref]
    assert im.scale_profile(im.multiscale(left, table(spark, noisy, b=["m"] * 12), "b")).first()["interpretation"] != im.COARSE


def test_two_channels_are_an_error(spark):
    two = table(spark, [np.zeros((2, 2, 2))])
    with pytest.raises(Exception, match="one channel"):
        im.channel_wasserstein(two, two.withColumn("b", F.lit("x")), "b").collect()


def test_image_severity_edges(spark):
    df = spark.createDataFrame([(0.0999,), (0.1,), (0.2499,), (0.25,)], "s double")
    assert [r[0] for r in df.select(image_severity(F.col("s"))).collect()] == ["low", "medium", "medium", "high"]


def brute_mmd(x, y):
    z = np.concatenate([x, y])
    d2 = ((z[:, None] - z[None]) ** 2).sum(-1)
    pos = d2[d2 > 0]
    gamma = 1 / ((np.median(pos) if len(pos) else 1.0) + 1e-8)
    k = np.exp(-gamma * d2)
    n, m = len(x), len(y)
    kxx, kyy, kxy = k[:n, :n], k[n:, n:], k[:n, n:]
    value = (kxx.sum() - np.trace(kxx)) / (n * (n - 1)) + (kyy.sum() - np.trace(kyy)) / (m * (m - 1)) - 2 * kxy.mean()
    return max(0.0, value), gamma


@pytest.mark.parametrize("block", [4, 1000])
def test_exact_mmd(spark, block):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(15, 4)), rng.normal(0.7, 1.0, size=(12, 4))
    y[:3] = x[:3]  # equal vectors: distance 0 is left out of the median
    x[5:9] = x[4]  # copies inside a side
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, v array<double>")
    got = mmd.embedding_mmd(left, right, "v", block).first()
    want, gamma = brute_mmd(x, y)
    assert got["mmd"] == pytest.approx(want, abs=1e-12) and got["gamma"] == pytest.approx(gamma, rel=1e-12)
    stored = mmd.embedding_mmd(left, right, "v", block, gamma=0.3).first()
    z = np.concatenate([x, y])
    k = np.exp(-0.3 * ((z[:, None] - z[None]) ** 2).sum(-1))
    inside = (k[:15, :15].sum() - 15) / (15 * 14) + (k[15:, 15:].sum() - 12) / (12 * 11)
    assert stored["gamma"] == 0.3 and stored["mmd"] == pytest.approx(max(0.0, inside - 2 * k[:15, 15:].mean()), abs=1e-12)
    assert mmd.embedding_mmd(left.limit(1), right, "v").first()["mmd"] == 0.0
    rough = mmd.mmd_features(left, right, "v", gamma, count=4096).first()["mmd"]
    assert rough == pytest.approx(want, abs=0.06)


def test_mmd_far_from_the_origin_and_all_bits_of_the_median(spark, monkeypatch):
    """Gram products lose the small distances there, and with few gathered pairs the ranks are read bit by bit."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(1e4, 1e-2, size=(40, 3)), rng.normal(1e4, 1.5e-2, size=(30, 3))
    sides = [spark.createDataFrame([(v.tolist(),) for v in rows], "v array<double>") for rows in (x, y)]
    want, gamma = brute_mmd(x, y)
    for gathered in (0, 1 << 20):
        monkeypatch.setattr(mmd, "GATHERED", gathered)
        got = mmd.embedding_mmd(*sides, "v", 16).first()
        assert got["gamma"] == pytest.approx(gamma, rel=1e-6) and got["mmd"] == pytest.approx(want, rel=1e-6)


def test_mmd_of_equal_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id long, v array<double>")
    row = mmd.embedding_mmd(same, same, "v", 2).first()
    assert row["mmd"] == pytest.approx(0.0)


def test_scenario_limits(spark):
    scores = spark.createDataFrame([("a", "r", 0.1), ("a", "g", 0.1), ("b", "r", 0.9), ("c", "r", 0.16)], "batch string, channel string, drift_score double")
    sig = spark.createDataFrame([("warm", "r", 0.13), ("warm", "g", 0.1), ("warm", "x", 9.0), ("cool", "r", 0.75), ("cool", "g", 0.0)], "scenario string, channel string, drift_score double")
    report = spark.createDataFrame([("warm", -0.2)], "scenario string, delta_accuracy double")
    got = {r["batch"]: r for r in im.match_scenarios(scores, sig, report).collect()}
    assert got["a"]["matched_scenario"] == "warm" and got["a"]["match_distance"] == pytest.approx(0.03) and got["a"]["confidence"] == "high"
    assert got["a"]["estimated_accuracy_drop"] == -0.2
    assert got["b"]["matched_scenario"] == "cool" and got["b"]["estimated_accuracy_drop"] is None and got["b"]["confidence"] == "low"
    far = im.match_scenarios(scores, sig, report, ImageDriftConfig(match_limit=0.01))
    assert far.count() == 0


@pytest.mark.parametrize("entries", [50_000, 7])
def test_scenarios_against_all_pairs(spark, monkeypatch, entries):
    """One block and many, with nulls, missing channels, ties, equal names in both tables and empty tables."""
    monkeypatch.setattr(im, "SIGNATURE_ENTRIES", entries)
    rng = np.random.default_rng(12)
    scores = [(f"b{i}", c, float(rng.integers(0, 4)) / 16) for i in range(30) for c in "rgb" if rng.random() < 0.8]
    scores += [("b0", None, 0.1), (None, "r", 0.1), ("lost", "r", None), ("far", "other", 0.0), ("b1", "r", None)]
    sig = [(f"s{i:02d}", c, float(rng.integers(0, 4)) / 16) for i in range(12) for c in "rgbx" if rng.random() < 0.7]
    sig += [("s00", "g", None), (None, "r", 0.0), ("null", "r", None)]
    want = {}
    for b in {x for x, _, _ in scores} - {None}:
        found = []
        for s in {x for x, _, _ in sig} - {None}:
            gaps = [(v - w) ** 2 for x, c, v in scores for y, k, w in sig if (x, y) == (b, s) and c == k and None not in (c, v, w)]
            if gaps and math.sqrt(sum(gaps)) <= 0.2:
                found.append((math.sqrt(sum(gaps)), s))
        if found:
            want[b] = min(found)
    left = spark.createDataFrame(scores, "batch string, channel string, drift_score double").withColumn("block", F.lit("x"))
    right = spark.createDataFrame(sig, "scenario string, channel string, drift_score double").withColumn("salt", F.lit("y"))
    got = {r["batch"]: (r["match_distance"], r["matched_scenario"]) for r in im.match_scenarios(left, right).collect()}
    assert {b: s for b, (_, s) in got.items()} == {b: s for b, (_, s) in want.items()}
    assert all(got[b][0] == pytest.approx(want[b][0], abs=1e-6) for b in want)
    assert im.match_scenarios(left, right.limit(0)).count() == 0 and im.match_scenarios(left.limit(0), right).count() == 0


def test_image_records(spark):
    rng = np.random.default_rng(8)
    ref = [rng.random((8, 8)) for _ in range(12)]
    left = table(spark, ref)
    cur = table(spark, [x + 0.3 for x in ref] + ref[:5], b=["lit"] * 12 + ["few"] * 5)
    row = monitor_images(left, cur, "b").collect()
    assert [r["batch"] for r in row] == ["lit"]
    assert row[0]["overall"]["severity"] == "high" and row[0]["channels"]["gray"]["drift_score"] == pytest.approx(0.3)
    assert row[0]["drift_type"] == "image_statistical" and row[0]["scenario_interpretation"] is None
    vectors = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(ref)], "id long, v array<double>")
    moved = spark.createDataFrame([(i, (x.ravel() + 5).tolist()) for i, x in enumerate(ref)], "id long, v array<double>")
    rec = monitor_embeddings(vectors, moved, "m", "v").first()
    assert rec["drift_type"] == "image_embedding" and rec["overall"]["severity"] == "high" and math.isfinite(rec["overall"]["drift_score"])
    assert monitor_embeddings(vectors, moved.limit(5), "m", "v").count() == 0
