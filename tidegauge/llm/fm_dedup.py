"""Repeated word windows, found with one compressed FM-index per shard.

A window is a number of consecutive words. Each window is filed under the least hash among the word n-grams in it, its
anchor; equal windows have equal anchors. Consecutive windows with one anchor are a segment, and only segments whose
anchor occurs again can hold a repeated window. Distinct segments are dealt to shards by anchor. A shard indexes its
segments (suffix order, Burrows-Wheeler transform, wavelet matrix of packed bits) and streams them against the index:
backward search finds the last window of a segment, then each window to the left costs one step, by shortening the
match to its parent interval and extending it by one word. A window's interval holds all its occurrences, and the
least (document, start) in it is where the window starts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunks, pieces_for, raw

WINDOW = 20
GRAM = 8
# Anchors that fill a large share of a sample of documents are chosen last, so that a line known to many documents
# does not gather all their neighbourhoods. This list only steers the choice of anchors, never a result.
HOT_SAMPLE = 16
HOT_LEAST = 64
HOT_MOST = 100_000
SHARD_BYTES = 4 * 1024 * 1024
# Bits of the sieve that spares anchors that occur once the shuffle; its size is fixed (4 MB), so on larger inputs it
# lets more of them through to the exact join behind it.
SIEVE_BITS = 1 << 25
NULL_ID = -(2**63)

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_ODD`` to the powers 0 to n - 1 and their inverses, modulo 2^64."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    out = []
    for base in (_ODD, inverse):
        run = np.full(n, base, np.uint64)
        run[:1] = 1
        out.append(np.multiply.accumulate(run))
    return out[0], out[1]


def segments(texts: list[bytes | None], hot: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(text index, start word, windows, anchor, content hash) of every segment of every text, as arrays."""
    bodies = [b" ".join(t.split()) if t else b"" for t in texts]
    buffer = b" ".join(bodies) + b" "
    octets = np.frombuffer(buffer, np.uint8)
    ends = np.flatnonzero(octets == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    real = ends > starts  # an empty text leaves an empty word
    starts, ends = starts[real], ends[real]
    sizes = np.array([len(b) + 1 for b in bodies])
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    n = len(starts)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none
    power, inverse = _powers(len(octets) + 1)
    sums = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    words = _mixed((sums[ends] - sums[starts]) * inverse[starts])
    marks = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        marks = marks * _ODD + words[i : n - gram + 1 + i]
    marks = _mixed(marks)
    order = marks >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, marks.view(np.int64)), len(hot) - 1)
        order |= (hot[at] == marks.view(np.int64)).astype(np.uint64) << np.uint64(63)

    def later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(order[b] <= order[a], b, a)  # of equal n-grams the last one

    best, width, reach = np.arange(len(marks)), 1, window - gram + 1
    while 2 * width <= reach:
        best = later(best[:-width], best[width:])
        width *= 2
    if width < reach:
        best = later(best[: len(best) - (reach - width)], best[reach - width :])
    place = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    if not len(place):
        return none, none, none, none, none
    anchor = best[place]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 1) | (np.diff(anchor) != 0))))
    count = np.diff(np.append(first, len(place)))
    begin, anchor = place[first], marks[anchor[first]].view(np.int64)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[begin].tolist(), ends[begin + count + window - 2].tolist())
    content = np.fromiter((digest(buffer[a:b]) for a, b in spans), np.uint64, len(begin)).view(np.int64)
    whose = owner[begin]
    zero = np.searchsorted(owner, whose, "left")
    return whose, begin - zero, count, anchor, content


class FmIndex:
    """The symbols of many segments, each ended by 0; patterns hold no 0 and are at most ``depth`` long."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        rank, step = symbols.astype(np.int64), 1
        while True:  # sorts by 1, 2, 4, ... symbols; order beyond ``depth`` is of no matter to the search
            if step >= depth:
                break
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
            step *= 2
        self.places = np.argsort(rank, kind="stable")
        self.size = n
        before = symbols[self.places - 1]
        alphabet = int(symbols.max()) + 1
        self.levels = max(1, (alphabet - 1).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        row = before.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.ranks.append(np.concatenate(([0], np.cumsum(ones)[:-1])))
            self.zeros.append(n - int(bit.sum()))
            row = np.concatenate((row[~bit], row[bit]))
        starts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet))))
        every = np.arange(alphabet)
        self.shift = starts[:-1] - self._descend(every, np.zeros(alphabet, np.int64))
        self.parent = self._intervals(symbols, depth - 1)

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for words, ranks, zeros, level in zip(self.words, self.ranks, self.zeros, range(self.levels - 1, -1, -1)):
            block, inside = place >> 6, (place & 63).astype(np.uint64)
            ones = ranks[block] + np.bitwise_count(words[block] & ((np.uint64(1) << inside) - np.uint64(1)))
            place = np.where(symbol >> level & 1, zeros + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``symbol`` followed by what the intervals low .. high - 1 stand for."""
        shift = self.shift[symbol]
        return self._descend(symbol, low) + shift, self._descend(symbol, high) + shift

    def _intervals(self, symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per suffix the interval of all that share its first ``depth`` symbols, from common prefix lengths."""
        same = np.ones(self.size - 1, bool)
        a, b = self.places[:-1], self.places[1:]
        padded = np.concatenate((symbols, np.zeros(depth, symbols.dtype)))
        for i in range(depth):
            same &= padded[a + i] == padded[b + i]
        edges = np.concatenate(([0], np.flatnonzero(~same) + 1, [self.size]))
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        return edges[:-1][group], edges[1:][group]


def first_starts(bodies: list[bytes], docs: np.ndarray, starts: np.ndarray, window: int = WINDOW):
    """Per segment of a shard, for each of its windows: (document, start) of the window's first occurrence.

    ``docs`` and ``starts`` tell where each segment's own first occurrence begins. Returns the number of windows per
    segment and two arrays over all windows, in order.
    """
    names: dict[bytes, int] = {}
    coded = [[names.setdefault(w, len(names) + 1) for w in body.split(b" ")] for body in bodies]
    sizes = np.array([len(c) for c in coded], np.int64)
    offset = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    symbols = np.zeros(int((sizes + 1).sum()), np.int64)
    inside = np.arange(len(symbols)) - np.repeat(offset, sizes + 1)
    segment = np.repeat(np.arange(len(sizes)), sizes + 1)
    symbols[inside < sizes[segment]] = np.fromiter((s for c in coded for s in c), np.int64, int(sizes.sum()))
    index = FmIndex(symbols, window)
    count = sizes - window + 1
    # Where each suffix's window starts in the corpus, as a rank that orders (document, start).
    doc, start = docs[segment], starts[segment] + inside
    order = np.lexsort((start, doc))
    standing = np.empty(len(order), np.int64)
    standing[order] = np.arange(len(order))
    least = standing[index.places]

    low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), index.size, np.int64)
    found = np.full((2, len(symbols)), -1, np.int64)
    for back in range(1, window + 1):
        low, high = index.extend(symbols[offset + sizes - back], low, high)
    at = offset + count - 1
    found[:, at] = low, high
    live, shorter = np.flatnonzero(count > 1), 2
    while len(live):
        wide_low, wide_high = index.parent[0][low[live]], index.parent[1][low[live]]
        at = offset[live] + count[live] - shorter
        low[live], high[live] = index.extend(symbols[at], wide_low, wide_high)
        found[:, at] = low[live], high[live]
        live, shorter = live[count[live] > shorter], shorter + 1
    windows = found[0] >= 0
    lows, highs = found[0][windows], found[1][windows]
    # Intervals of one length are apart or equal: each is searched for its least once.
    lows, first, which = np.unique(lows, return_index=True, return_inverse=True)
    cuts = np.stack((lows, highs[first]), axis=1).ravel()
    best = np.minimum.reduceat(np.append(least, 0), cuts)[::2][which]
    return count, doc[order][best], start[order][best]


def _hot_anchors(docs: DataFrame, runs) -> np.ndarray:
    sample = docs.where(F.pmod(F.xxhash64("did"), F.lit(HOT_SAMPLE)) == 0)
    rows = (
        runs(sample, np.zeros(0, np.int64))
        .groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= HOT_LEAST)
        .orderBy(F.desc("n"), "anchor")
        .limit(HOT_MOST)
    )
    return np.sort(np.array([r[0] for r in rows.select("anchor").collect()], np.int64))


def _sieve(again: DataFrame) -> np.ndarray:
    """A bit for each remainder of a repeated anchor, as 64-bit words; at most SIEVE_BITS / 64 rows come here."""
    place = F.pmod(F.col("anchor"), F.lit(SIEVE_BITS))
    words = again.select((place / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(anchor, {SIEVE_BITS}) % 64 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    sieve = np.zeros(SIEVE_BITS // 64, np.uint64)
    sieve[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return sieve


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(documents, marks): documents has did and text; marks has, per did, the windows that start earlier elsewhere.

    A mark is a segment's start, windows and content hash, and the places among them of its windows to remove.
    """
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words or more")
    docs = df.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("did"), F.col(text).cast("binary").alias("text")
    )

    def runs(source: DataFrame, hot: np.ndarray, sieve: np.ndarray | None = None) -> DataFrame:
        shared = source.sparkSession.sparkContext.broadcast((hot, sieve))  # HOT_MOST numbers and SIEVE_BITS at most

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in chunks(batches):
                hot, sieve = shared.value
                found = segments(raw(rows.column(1)), hot, window)
                if sieve is not None:
                    place = found[3] % SIEVE_BITS
                    kept = (sieve[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                    found = [x[kept] for x in found]
                whose, start, count, anchor, content = found
                ids = rows.column(0).to_numpy(zero_copy_only=False)[whose]
                columns = [anchor, content, ids, start.astype(np.int32), count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "content", "did", "start", "n"])

        return source.mapInArrow(cut, "anchor long, content long, did long, start int, n int")

    hot = _hot_anchors(docs, runs)
    counts = runs(docs, hot).groupBy("anchor").agg(F.count(F.lit(1)).alias("times"))
    again = checkpointed(counts.where("times > 1").select("anchor"))
    candidates = checkpointed(runs(docs, hot, _sieve(again)).join(again, "anchor", "left_semi"))
    distinct = candidates.groupBy("anchor", "content").agg(
        F.min(F.struct("did", "start", "n")).alias("first")
    )
    wanted = (
        distinct.select("first.did", F.struct("anchor", "content", "first.start", "first.n").alias("segment"))
        .groupBy("did")
        .agg(F.collect_list("segment").alias("segments"))  # a document's own segments
    )
    shards = pieces_for(df, SHARD_BYTES)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            out = {"shard": [], "anchor": [], "content": [], "did": [], "start": [], "body": []}
            for did, text, asked in zip(rows.column(0).to_pylist(), raw(rows.column(1)), rows.column(2).to_pylist()):
                words = (text or b"").split()
                for s in asked:
                    body = b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1])
                    if _content(body) != s["content"]:
                        continue  # of another text under the same id
                    out["shard"].append(s["anchor"] % shards)
                    out["anchor"].append(s["anchor"])
                    out["content"].append(s["content"])
                    out["did"].append(did)
                    out["start"].append(s["start"])
                    out["body"].append(body)
            yield pa.RecordBatch.from_pydict(out, schema=shape)

    shape = pa.schema(
        [("shard", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("did", pa.int64()), ("start", pa.int64()), ("body", pa.binary())]
    )
    bodies = (
        docs.join(wanted, "did")
        .select("did", "text", "segments")
        .mapInArrow(fetch, "shard long, anchor long, content long, did long, start long, body binary")
    )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["anchor", "content"])  # rows repeated in the input fetch a segment twice
        count, docs, starts = first_starts(
            [bytes(b) for b in rows["body"]], rows["did"].to_numpy(np.int64), rows["start"].to_numpy(np.int64), window
        )
        cuts = np.cumsum(count)[:-1]
        return pd.DataFrame(
            {
                "anchor": rows["anchor"].to_numpy(),
                "content": rows["content"].to_numpy(),
                "docs": np.array(np.split(docs, cuts) + [None], dtype=object)[:-1],
                "starts": np.array(np.split(starts, cuts) + [None], dtype=object)[:-1],
            }
        )

    found = bodies.groupBy("shard").applyInPandas(search, "anchor long, content long, docs array<long>, starts array<long>")
    earlier = F.expr("filter(sequence(0, n - 1), i -> docs[i] < did OR (docs[i] = did AND starts[i] < start + i))")
    marks = (
        candidates.join(found, ["anchor", "content"])
        .select("did", "start", "n", "content", earlier.alias("gone"))
        .where("size(gone) > 0")
        .groupBy("did")
        .agg(F.collect_list(F.struct("start", "n", "content", "gone")).alias("marks"))  # a document's own segments
    )
    return docs, marks


def _content(body: bytes) -> int:
    digest = xxhash.xxh64_intdigest(body)
    return digest - (1 << 64) if digest >> 63 else digest


def keep_mask(words: list[bytes], marks: list[dict] | None, window: int) -> np.ndarray:
    """Which words stay, given a text's marks; marks whose content is not this text's are another row's."""
    edge = np.zeros(len(words) + 1, np.int64)
    for m in marks or ():
        if _content(b" ".join(words[m["start"] : m["start"] + m["n"] + window - 1])) != m["content"]:
            continue
        for i in m["gone"]:
            edge[m["start"] + i] += 1
            edge[m["start"] + i + window] -= 1
    return np.cumsum(edge)[:-1] == 0


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): each text without the words of windows that start earlier.

    A window starts earlier in a smaller doc_id, or sooner in the same document; windows are judged on the input.
    ``kept`` is the kept words joined by one space. A null text has no words; texts shorter than a window lose none. A
    null doc_id comes before all others. Rows that share a doc_id are one document: a window at the same word of two of
    them is no repeat, so repeated rows get equal results. Other columns are ignored. No rows give no rows.
    """
    docs, marks = repeated(df, key, text, window)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            total, removed, digests, bodies = [], [], [], []
            for text, marks in zip(raw(rows.column(1)), rows.column(2).to_pylist()):
                words = (text or b"").split()
                stay = keep_mask(words, marks, window)
                body = b" ".join(words) if stay.all() else b" ".join(w for w, s in zip(words, stay.tolist()) if s)
                total.append(len(words))
                removed.append(len(words) - int(stay.sum()))
                digests.append(hashlib.sha256(body).hexdigest())
                bodies.append(body)
            columns = [rows.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["did", "n_words", "n_removed", "kept_sha256", "kept"])

    rows = docs.join(marks, "did", "left").select("did", "text", "marks")
    shape = "did long, n_words long, n_removed long, kept_sha256 string, kept binary"
    name: Column = F.when(F.col("did") != NULL_ID, F.col("did")).alias("doc_id")
    return rows.mapInArrow(apply, shape).select(
        name, "n_words", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept")
    )


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with the same words taken out of its texts; all rows and columns stay.

    A text that loses words becomes its kept words joined by one space, and empty if none are left; others are as they
    were, null included. Names that the work needs are made so that they clash with no column of ``df``.
    """
    _, marks = repeated(df, key, text, window)
    taken, did, own = {c.lower() for c in df.columns}, "repeat_of", "repeat_marks"
    while did in taken:
        did += "_"
    while own in taken:
        own += "_"

    kind = "array<struct<start:int,n:int,content:long,gone:array<int>>>"

    @F.arrow_udf("binary")
    def cut(texts: pa.Array, marks: pa.Array) -> pa.Array:
        def kept(body: bytes | None, found: list[dict] | None) -> bytes | None:
            if body is None or found is None:
                return body
            words = body.split()
            stay = keep_mask(words, found, window)
            return body if stay.all() else b" ".join(w for w, s in zip(words, stay.tolist()) if s)

        # A few rows at a time are Python objects; the rest of the batch stays in Arrow's columns.
        rows = [
            pa.array([kept(t.as_py(), m.as_py()) for t, m in zip(texts[lo : lo + 256], marks[lo : lo + 256])], pa.binary())
            for lo in range(0, len(texts), 256)
        ]
        return pa.concat_arrays(rows) if rows else pa.array([], pa.binary())

    named = marks.select(F.col("did").alias(did), F.col("marks").cast(kind).alias(own))
    same = F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)) == F.col(did)
    clean = cut(F.col(text).cast("binary"), F.col(own)).cast("string")
    joined = df.join(named, same, "left")
    return joined.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
