"""Language ID by rank-order profiles: out-of-place distance of a text's most frequent n-grams to each language's."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, chunks, raw

# The classifier is fitted on at most this many labelled texts of each language, those with the least hashes.
SAMPLE_PER_LANG = 2000
# Ranks kept of a text and of a language, and the longest n-gram.
PROFILE = 400
LONGEST = 3
UNKNOWN = "und"
# Languages whose bounds may be broadcast (a name and a number each).
BROADCAST_LANGS = 100_000
# First bits of a hash by which a language's rows are counted.
NEAR_BITS = 12
_POINTS = 0x110000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(_POINTS)), bool, _POINTS)


def ranked_grams(texts: list[bytes | None], most: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, str, int]]:
    """Per text and n: (text index, gram codes by falling count, counts, alphabet, n), for n from 1 to ``LONGEST``.

    A gram runs over lower-cased letters; all else between words is one blank. A code is the gram's letters as digits
    to the base of the alphabet's size. Ties in the count go to the gram whose letters come first. ``most`` bounds the
    codes given per text and n, None gives all. Texts without a letter give nothing.
    """
    bodies = [np.frombuffer(t.decode("utf-8", "replace").lower().encode("utf-32-le"), "<u4") if t else None for t in texts]
    kept = [i for i, b in enumerate(bodies) if b is not None and len(b)]
    if not kept:
        return
    gap = np.array([32], "<u4")
    run = np.concatenate([x for i in kept for x in (gap, bodies[i], gap)])
    owner = np.repeat(np.arange(len(kept)), [len(bodies[i]) + 2 for i in kept])
    run = np.where(_letters()[run], run, 32)
    blank = run == 32
    again = np.zeros(len(run), bool)
    again[1:] = blank[1:] & blank[:-1] & (owner[1:] == owner[:-1])
    run, owner = run[~again], owner[~again]
    used = np.zeros(_POINTS, bool)
    used[run] = True
    used[32] = True
    points = np.flatnonzero(used)
    alphabet = "".join(map(chr, points.tolist()))
    code = np.zeros(_POINTS, np.int64)
    code[points] = np.arange(len(points))
    digits, base = code[run], len(points)
    space = code[32]
    worded = np.zeros(len(kept), bool)
    np.logical_or.at(worded, owner[digits != space], True)
    gram = digits
    for n in range(1, LONGEST + 1):
        if n > 1:
            gram = gram[: len(digits) - n + 1] * base + digits[n - 1 :]
        whole = owner[: len(gram)] == owner[n - 1 :] if n > 1 else np.ones(len(gram), bool)
        if n == 1:
            whole = whole & (digits != space)
        size = base**n
        if len(kept) * size >= 1 << 62:
            raise OverflowError("the caller must give fewer texts of so large an alphabet")
        keys = np.sort(owner[: len(gram)][whole] * size + gram[whole])
        if not len(keys):
            continue
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        by = np.lexsort((keys, -counts, keys // size))
        keys, counts = keys[by], counts[by]
        whose = keys // size
        starts = np.searchsorted(whose, np.arange(len(kept) + 1))
        for i, name in enumerate(kept):
            lo, hi = starts[i], starts[i + 1]
            if lo < hi and worded[i]:
                hi = hi if most is None else min(hi, lo + most)
                yield name, keys[lo:hi] - i * size, counts[lo:hi], alphabet, n


def _safe(texts: list[bytes | None], most: int | None):
    """``ranked_grams`` over as few texts at a time as their alphabet needs for codes of 62 bits."""
    try:
        yield from list(ranked_grams(texts, most))
    except OverflowError:
        half = len(texts) // 2
        for base, part in ((0, texts[:half]), (half, texts[half:])):
            for name, *rest in _safe(part, most):
                yield base + name, *rest


def _spell(codes: np.ndarray, alphabet: str, n: int) -> list[str]:
    base, letters = len(alphabet), np.array(list(alphabet))
    out = np.full(len(codes), "", dtype=f"<U{n}")
    for place in range(n - 1, -1, -1):
        out = np.char.add(out, letters[codes // base**place % base])
    return out.tolist()


def _per_lang(rows: DataFrame) -> DataFrame:
    """``rows``, one a language, written down, and broadcast if they are few."""
    rows = checkpointed(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_LANGS else rows


def fit_profiles(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, dict[str, int]]:
    """language -> {gram: rank from 0}: the ``PROFILE`` most frequent grams of each n over a bounded sample of texts.

    Reads rows with a language and a text. The sample is per language the ``SAMPLE_PER_LANG`` rows with the least hash
    of key and text, so it does not depend on partitions or size. What comes to the driver is ``LONGEST * PROFILE``
    rows a language.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"),
        F.col(text).cast("binary").alias("text"),
        F.xxhash64(F.lit("profile"), F.col(key), F.col(text)).alias("draw"),
    )
    # Hashes are counted by their first bits, and only those up to the bits that complete a language's sample are
    # ranked, so no task orders a language's hashes. The texts are read again, behind a bound on the hash.
    near = F.shiftright("draw", 64 - NEAR_BITS)
    before = Window.partitionBy("lang").orderBy("near").rowsBetween(Window.unboundedPreceding, -1)
    reach = (
        rows.groupBy("lang", near.alias("near"))
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        .where(F.col("before") < SAMPLE_PER_LANG)
        .groupBy("lang")
        .agg(F.max("near").alias("reach"))
    )
    place = Window.partitionBy("lang").orderBy("draw")
    bound = (
        rows.select("lang", "draw")
        .join(_per_lang(reach), "lang")
        .where(near <= F.col("reach"))
        .select("lang", "draw", F.row_number().over(place).alias("place"))
        .where(F.col("place") <= SAMPLE_PER_LANG)
        .groupBy("lang")
        .agg(F.max("draw").alias("bound"))
    )
    bound = _per_lang(bound)
    sample = rows.join(bound, "lang").where("draw <= bound").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            langs, texts = part.column(0).to_pylist(), raw(part.column(1))
            for name in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == name]
                total: dict[tuple[int, str], int] = {}
                for _, codes, counts, alphabet, n in _safe(own, None):
                    for gram, c in zip(_spell(codes, alphabet, n), counts.tolist()):
                        total[n, gram] = total.get((n, gram), 0) + c
                yield pa.RecordBatch.from_pydict(
                    {"lang": [name] * len(total), "n": [n for n, _ in total], "gram": [g for _, g in total], "c": list(total.values())}
                )

    counts = sample.mapInArrow(count, "lang string, n long, gram string, c long")
    best = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram")
    ranked = (
        counts.groupBy("lang", "n", "gram")
        .agg(F.sum("c").alias("c"))
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= PROFILE)
    )
    profiles: dict[str, dict[str, int]] = {}
    for row in ranked.select("lang", "gram", "place").collect():
        profiles.setdefault(row["lang"], {})[row["gram"]] = row["place"] - 1
    return profiles


def classify(texts: list[bytes | None], profiles: dict[str, dict[str, int]]) -> tuple[list[str], np.ndarray]:
    """The nearest language of each text and a score from 0 to 1.

    The distance to a language is the mean over the text's grams of the difference in rank, ``PROFILE`` for a gram the
    profile lacks; each n is ranked by itself. The score is 1 minus the distance's share of its largest value. Ties go
    to the name that comes first. Without a letter, or without profiles, the language is ``und`` with score 0.
    """
    names = sorted(profiles)
    far, ranks = np.zeros((len(texts), len(names))), np.zeros(len(texts))
    tables: dict[tuple[str, int], dict[str, np.ndarray]] = {}
    for i, codes, _, alphabet, n in _safe(texts, PROFILE):
        if (alphabet, n) not in tables:
            own, base = {c: j for j, c in enumerate(alphabet)}, len(alphabet)
            tables[alphabet, n] = {}
            for name in names:
                pairs = sorted(
                    (sum(own[c] * base ** (n - 1 - j) for j, c in enumerate(g)), r)
                    for g, r in profiles[name].items()
                    if len(g) == n and all(c in own for c in g)
                )
                tables[alphabet, n][name] = np.array(pairs, np.int64).reshape(-1, 2)
        place = np.arange(len(codes))
        for j, name in enumerate(names):
            pairs = tables[alphabet, n][name]
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs[:, 0], codes), len(pairs) - 1)
                off = np.where(pairs[at, 0] == codes, np.abs(pairs[at, 1] - place), PROFILE)
                far[i, j] += np.minimum(off, PROFILE).sum()
            else:
                far[i, j] += PROFILE * len(codes)
        ranks[i] += len(codes)
    known = (ranks > 0) & bool(names)
    best = far.argmin(axis=1) if names else np.zeros(len(texts), int)
    score = np.zeros(len(texts))
    if names:
        score[known] = 1 - far[known, best[known]] / (PROFILE * ranks[known])
    return [names[b] if k else UNKNOWN for b, k in zip(best, known)], score


def predict(df: DataFrame, profiles: dict[str, dict[str, int]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from the whole text and nothing else; no row is moved.

    A null text, or one without a letter, is ``und`` with score 0. Other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # languages x LONGEST x PROFILE grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            names, score = classify(raw(rows.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    source = df.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def prediction(text: Column, profiles: dict[str, dict[str, int]], spark) -> Column:
    """The same as a column (struct of lang_pred and score) beside all others of a row."""
    shared = spark.sparkContext.broadcast(profiles)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def run(column: pd.Series) -> pd.DataFrame:
        names, scores, values = [], [], [None if x is None else bytes(x) for x in column]
        lo = 0
        while lo < len(values):
            hi, size = lo, 0
            while hi < len(values) and (hi == lo or size + len(values[hi] or b"") <= 1 << 21):
                size += len(values[hi] or b"")
                hi += 1
            part, score = classify(values[lo:hi], shared.value)
            names += part
            scores += score.tolist()
            lo = hi
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return run(text.cast("binary"))
