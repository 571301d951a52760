"""SimHash fingerprints linked within a Hamming radius by vantage-point trees.

Two fingerprints that differ in at most ``radius`` bits agree wholly on at least ``equal`` of ``radius + equal`` blocks
of bits. For each choice of ``equal`` blocks a vantage-point tree splits the fingerprints by their Hamming distance
on those blocks alone. That distance never exceeds the whole one, and for the blocks on which a pair agrees the ball
around a fingerprint has radius 0, so each pair meets in one shard of one tree at least. A tree over all 64 bits
would not do: distances of unrelated fingerprints crowd around 32, and a ball of radius 4 overlaps nearly every split.
Inside a shard a vantage-point tree over all bits finds the pairs: a query enters each branch that its ball overlaps.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunks, components, raw

BITS = 64
SEED = 42
# Fingerprints a shard should hold, the sample its splits are drawn from (driver memory: 8 bytes each), and the points
# of a leaf below which all distances are computed.
SHARD_POINTS = 2048
SAMPLE = 65_536
LEAF = 128
# Distances held at a time, some 30 bytes each where all points are near.
BLOCK_PAIRS = 1 << 18

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _hashed_shingles(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, in blocks: bounded memory for very long texts."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    reach = min(shingle, len(words)) - 1
    hashed, total = xxhash.xxh64_intdigest, len(words) - reach
    for lo in range(0, total, 1 << 16):
        hi = min(total, lo + (1 << 16))
        spans = zip(starts[lo:hi].tolist(), ends[lo + reach : hi + reach].tolist())
        yield np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, hi - lo)


def _votes(values: np.ndarray) -> np.ndarray:
    """How many of the values have each bit set."""
    octets = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])


def _mixed(values: np.ndarray, part: int) -> np.ndarray:
    """The hashes of a further part: the values shifted by a multiple of the golden ratio and mixed (SplitMix64)."""
    if not part:
        return values
    x = values + np.uint64(part * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(blocks: Iterable[np.ndarray], parts: int) -> np.ndarray:
    counts, total = np.zeros((parts, BITS), np.int64), 0
    for values in blocks:
        total += len(values)
        for part in range(parts):
            counts[part] += _votes(_mixed(values, part))
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view("<u8")[:, 0]


def wide_fingerprint(text: bytes | None, shingle: int, parts: int) -> np.ndarray:
    """``parts`` times 64 bits, each set if set in over half of the hashes of the text's shingles, repeats included."""
    return _majority(_hashed_shingles(text, shingle), parts)


def _distinct(blocks: list[np.ndarray]) -> np.ndarray:
    """A text's set of shingle hashes, in order."""
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def _digest(values: np.ndarray) -> int:
    digest = xxhash.xxh64_intdigest(values.astype("<u8").tobytes(), SEED)
    return digest - (1 << 64) if digest >> 63 else digest


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64 bits, each set if set in over half of the hashes of the text's shingles, repeats included."""
    return int(wide_fingerprint(text, shingle, 1)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a signed long. A null or wordless text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            marks = np.array([fingerprint(x, shingle) for x in raw(rows.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(marks)], names=["doc_id", "fp"])

    source = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _wide_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all points of ``a`` and of ``b``; the parts of a point lie along the last axis."""
    away = np.zeros((len(a), len(b)), np.int16)
    for part in range(a.shape[1]):
        away += _distance(a[:, part, None], b[None, :, part])
    return away


def block_masks(radius: int, equal: int) -> list[int]:
    """The choices of ``equal`` out of ``radius + equal`` blocks, each as a mask of the bits compared."""
    cuts = [BITS * i // (radius + equal) for i in range(radius + equal + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, equal)]


def grow(sample: np.ndarray, mask: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The vantage points and split distances of a tree of ``depth`` levels, node ``i`` above ``2 i + 1`` and ``2 i + 2``.

    A node splits its part of the sample at the median distance from the candidate whose distances spread most. A node
    that cannot split has distance 64: all its points go on to the left.
    """
    nodes = (1 << depth) - 1
    vantage, cut = np.zeros(nodes, np.uint64), np.full(nodes, BITS, np.uint8)
    mask, parts = np.uint64(mask), {0: sample & np.uint64(mask)}
    for node in range(nodes):
        own = parts.pop(node, None)
        if own is None or len(own) < 2:
            continue
        tried = own[:: max(1, len(own) // 4)][:4]
        away = [_distance(own, v) for v in tried]
        best = int(np.argmax([d.std() for d in away]))
        middle = int(np.median(away[best]))
        right = away[best] > middle
        if not right.any():  # half of the points or more are at the largest distance
            middle -= 1
            right = away[best] > middle
        if middle < 0 or right.all():
            continue
        vantage[node], cut[node] = tried[best], middle
        parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    return vantage, cut


def route(points: np.ndarray, mask: int, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    vantage, cut = tree
    node = np.zeros(len(points), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (_distance(points, vantage[node] & np.uint64(mask)) > cut[node])
    return node


def near_pairs(points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius``, each at least once, by a vantage-point tree over ``points`` in bounded blocks.

    ``points`` has a row for each fingerprint and a column for each of its parts.
    """
    stack = [(np.arange(len(points)), np.arange(len(points)))]
    while stack:
        inside, asking = stack.pop()
        if not len(inside) or not len(asking):
            continue
        split = False
        if len(inside) > LEAF:
            vantage = points[inside[len(inside) // 2]][None, :]
            away = _wide_distance(points[inside], vantage)[:, 0]
            middle = int(np.median(away))
            right = away > middle
            if right.any() and not right.all():
                split = True
                query = _wide_distance(points[asking], vantage)[:, 0]
                # Within the radius of a point at distance d from the vantage point lie only d - radius .. d + radius.
                stack.append((inside[~right], asking[query <= middle + radius]))
                stack.append((inside[right], asking[query > middle - radius]))
        if not split:
            rows = max(1, BLOCK_PAIRS // len(inside))
            for lo in range(0, len(asking), rows):
                block = asking[lo : lo + rows]
                i, j = np.nonzero(_wide_distance(points[block], points[inside]) <= radius)
                i, j = block[i], inside[j]
                keep = i < j
                if keep.any():
                    yield i[keep], j[keep]


def _roots(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point the index of the least point of its component among ``points``."""
    parent = np.arange(len(points))

    def settle(x: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := parent[x], x):
            x = up
        return x

    for i, j in near_pairs(points, radius):
        while True:
            a, b = settle(i), settle(j)
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    return settle(np.arange(len(points)))


def _resemble(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, given in order, share at least this part of their union; two empty sets do."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return not union or both / union >= similarity


def _alike_roots(points: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> np.ndarray:
    """As ``_roots``, but of the pairs within ``radius`` only those whose sets resemble each other are links.

    A pair already joined is not compared, so a group of near copies costs a comparison per member.
    """
    parent = np.arange(len(points))

    def settle(x: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := parent[x], x):
            x = up
        return x

    for i, j in near_pairs(points, radius):
        while True:
            parent = settle(parent)
            a, b = parent[i], parent[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            _, first = np.unique(np.minimum(a, b) * len(points) + np.maximum(a, b), return_index=True)
            for n in first.tolist():  # one pair for each two groups
                x, y = settle(i[n : n + 1])[0], settle(j[n : n + 1])[0]
                if x != y and _resemble(sets[i[n]], sets[j[n]], similarity):
                    parent[max(x, y)] = min(x, y)
            rest = np.ones(len(i), bool)
            rest[first] = False
            i, j = i[rest], j[rest]
    return settle(np.arange(len(points)))


def links(marks: DataFrame, radius: int = 4, equal: int = 1) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of values of ``fp`` within ``radius`` bits.

    ``marks`` has one long column ``fp`` of distinct values. A shard gives one edge for each point that is not the
    least of its local component, so a group of near copies costs a row per member, never one per pair.
    """
    sample = marks.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, marks.count() / SHARD_POINTS)))))
    depth = min(depth, max(0, int(np.log2(max(1, len(sample) / 4)))))
    masks = block_masks(radius, equal)
    trees = [grow(sample, mask, depth) for mask in masks]
    shared = marks.sparkSession.sparkContext.broadcast((masks, trees))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, trees = shared.value
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, (mask, tree) in enumerate(zip(masks, trees)):
                own = points & np.uint64(mask)
                shard = route(own, mask, tree, depth)
                key = pa.array((np.int64(number) << np.int64(40)) | shard)
                yield pa.RecordBatch.from_arrays([key, batch.column(0)], names=["shard", "fp"])

    def join(batch: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(batch["fp"].to_numpy(np.int64).view(np.uint64))
        root = points[_roots(points[:, None], radius)]
        apart = root != points
        return pd.DataFrame({"a": points[apart].view(np.int64), "b": root[apart].view(np.int64)})

    placed = marks.mapInArrow(place, "shard long, fp long")
    return placed.groupBy("shard").applyInPandas(join, "a long, b long")


def near_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, equal: int = 1
) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id reachable over links of at most ``radius`` bits, one row per row.

    Fingerprints are the nodes, so equal ones meet before any comparison and a group of copies is one point with its
    least doc_id. A null doc_id takes part but is never a component's id unless all of it is null; repeated rows give
    repeated results; a text without words has fingerprint 0, which links like any other. No rows give no rows.
    """
    marks = checkpointed(fingerprints(df, key, text, shingle))
    nodes = checkpointed(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fp"), radius, equal))
    grouped = (
        nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("component", F.coalesce("component", "fp"))
        .select("fp", "least", "component")
    )
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "component").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


# Wide fingerprints, for a similarity that 64 bits cannot tell: the share of bits in which two texts differ is the
# angle between their shingle vectors over pi, so 0.8 means 15 % of the bits.
PARTS = 4
BLOCK = 9  # Bits that two fingerprints must share to meet in one of the tables, and tables a part of 64 bits gives.
TABLES = 7
# Standard deviations beyond the expected distance within which pairs are compared shingle by shingle.
SEARCH_DEVIATIONS = 3.0


def similarity_radius(similarity: float, parts: int = PARTS, deviations: float = 1.0) -> int:
    """The bits in which texts of this resemblance differ by expectation, and so many standard deviations more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(parts * BITS * share + deviations * np.sqrt(parts * BITS * share * (1 - share)))


def similar_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """(doc_id, component_id): the least doc_id reachable over links of resemblance ``similarity`` or more, one row per row.

    A link is a pair whose sets of shingles share that part of their union. Candidates are pairs of fingerprints of 256
    bits within the expected distance and three deviations. Each block of 9 bits makes a table, in which a vantage-point
    tree splits the fingerprints by their distance on the block; a pair that agrees on a block meets in a shard, where a
    vantage-point tree over all bits finds it. The texts of each group of candidates then come together once, and pairs
    not yet joined are compared by their shingles. By the binomial model 99.9 % of the pairs at 0.8 meet in one of the
    28 tables and 99.9 % lie within the distance, more of those above. Texts of one set of shingles are one point. Cells
    of a table hold a 512th of the points, so a corpus over 10^7 different texts wants wider blocks and more parts; one
    task reads a whole group of candidates.

    A null doc_id takes part but is never a component's id unless all of it is null; repeated rows give repeated
    results; texts without words are one group. No rows give no rows.
    """
    names = [f"fp{i}" for i in range(PARTS)]
    radius = similarity_radius(similarity, deviations=SEARCH_DEVIATIONS)
    long_names = ", ".join(f"{n} long" for n in names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            marks, digests = [], []
            for x in raw(rows.column(1)):
                blocks = list(_hashed_shingles(x, shingle))
                marks.append(_majority(blocks, PARTS))
                digests.append(_digest(_distinct(blocks)))
            parts = np.array(marks, np.uint64).view(np.int64).reshape(-1, PARTS).T.copy()
            columns = [rows.column(0), rows.column(2), pa.array(digests, pa.int64()), *map(pa.array, parts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "body", "shingles", *names])

    source = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    source = source.withColumn("body", F.xxhash64("text"))
    marks = checkpointed(source.mapInArrow(mark, f"doc_id long, body long, shingles long, {long_names}"))
    nodes = checkpointed(marks.groupBy(*names, "shingles").agg(F.min("doc_id").alias("least"), F.min("body").alias("body")))
    points = nodes.withColumn("node", F.monotonically_increasing_id())

    sample = nodes.orderBy(F.xxhash64(*names), *names).limit(SAMPLE // PARTS).select(*names).toPandas().to_numpy(np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, nodes.count() / SHARD_POINTS)))))
    depth = min(depth, max(0, int(np.log2(max(1, len(sample) / 4)))))
    masks = [(part, ((1 << BLOCK) - 1) << BLOCK * i) for part in range(PARTS) for i in range(TABLES)]
    tables = [(part, mask, grow(np.ascontiguousarray(sample[:, part]), mask, depth)) for part, mask in masks]
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, (part, mask, tree) in enumerate(shared.value):
                own = batch.column(part).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(mask)
                shard = (np.int64(number) << np.int64(40)) | route(own, mask, tree, depth)
                yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", *batch.schema.names])

    def join(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("node")
        node = batch["node"].to_numpy(np.int64)
        root = node[_roots(batch[names].to_numpy(np.int64).view(np.uint64), radius)]
        apart = root != node
        return pd.DataFrame({"a": node[apart], "b": root[apart]})

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("node")
        node = batch["node"].to_numpy(np.int64)
        sets = [_distinct(list(_hashed_shingles(None if x is None else bytes(x), shingle))) for x in batch["text"]]
        root = node[_alike_roots(batch[names].to_numpy(np.int64).view(np.uint64), sets, radius, similarity)]
        return pd.DataFrame({"node": node, "component": root})

    placed = points.select(*names, "node").mapInArrow(place, f"shard long, {long_names}, node long")
    near = components(placed.groupBy("shard").applyInPandas(join, "a long, b long"))
    members = points.join(near, "node").select("node", "component", "body", *names)
    bodies = source.select("body", "text").join(members.select("body").distinct(), "body", "left_semi")
    bodies = bodies.groupBy("body").agg(F.first("text").alias("text"))  # copies of a text are compared once
    found = members.join(bodies, "body").groupBy("component").applyInPandas(compare, "node long, component long")
    grouped = points.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "component").select(*names, "shingles", "component_id")
    return marks.join(named, [*names, "shingles"]).select("doc_id", "component_id")
