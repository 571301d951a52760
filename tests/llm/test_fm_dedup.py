import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import fm_dedup
from tidegauge.llm.fm_dedup import FmIndex, drop_repeats, without_repeats


def brute(rows, window=20):
    """Per row (id, words, removed, sha, kept); ids in order, None first."""
    first, cut = {}, []
    for i, t in rows:
        words = (t or "").encode().split()
        cut.append((i, words))
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            at = (i is not None, i or 0, p)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, words in cut:
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < (i is not None, i or 0, p):
                gone |= set(range(p, p + window))
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def check(df, rows):
    assert sorted(map(tuple, drop_repeats(df).collect()), key=str) == brute(rows)


def test_messy(messy, messy_rows, nothing):
    check(messy, [(r[0], r[1]) for r in messy_rows])
    assert drop_repeats(nothing).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", [0, 1])
def test_few_words_and_hot_anchors(spark, seed, monkeypatch):
    """Small vocabularies repeat windows inside and across texts; a common line makes hot anchors."""
    monkeypatch.setattr(fm_dedup, "HOT_LEAST", 2)
    monkeypatch.setattr(fm_dedup, "HOT_SAMPLE", 2)
    rng = np.random.default_rng(seed)
    line = " ".join(f"common{i}" for i in range(25))
    rows = []
    for i in range(120):
        words = [f"v{x}" for x in rng.integers(0, 2 + i % 3, rng.integers(0, 90))]
        if i % 3 == 0:
            words = [*(f"u{i}.{j}" for j in range(int(rng.integers(0, 30)))), line, *(f"u{i}-{j}" for j in range(9))]
        rows.append((int(rng.integers(0, 10**6)), " ".join(words)))
    rows += [(10**6 + 1, "a b " * 200), (10**6 + 2, rows[1][1]), (10**6 + 3, "x " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(df, rows)


def test_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (1, "head " + text), (2, text)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_texts_keep_their_rows_and_columns(messy, messy_rows):
    out = without_repeats(messy)
    assert out.schema == messy.schema
    want = {r[0]: r for r in brute([(r[0], r[1]) for r in messy_rows])}
    rows = out.where(F.col("doc_id").isNotNull()).collect()
    assert len(rows) == sum(r[0] is not None for r in messy_rows)
    old = {r[0]: r[1] for r in messy_rows}
    for r in rows:
        assert r["text"] == (want[r["doc_id"]][4] if want[r["doc_id"]][2] else old[r["doc_id"]])


def test_index_counts_every_pattern():
    rng = np.random.default_rng(4)
    symbols = rng.integers(1, 7, 4000)
    symbols[rng.integers(0, 4000, 100)] = 0
    symbols[-1] = 0
    index, text = FmIndex(symbols, 6), symbols.tolist()
    for size in (1, 2, 3, 6):
        for _ in range(60):
            pattern = rng.integers(1, 7, size).tolist()
            low, high = np.array([0]), np.array([len(text)])
            for s in reversed(pattern):
                low, high = index.extend(np.array([s]), low, high)
            places = sorted(index.places[low[0] : high[0]].tolist())
            assert places == [i for i in range(len(text)) if text[i : i + size] == pattern]


@pytest.mark.parametrize("window", [8, 20, 39, 40, 50, 90])
def test_windows_of_any_width(spark, window):
    rng = np.random.default_rng(window)
    passage = " ".join(f"p{x}" for x in range(130))
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 60)) + (f" {passage}" if i % 3 == 0 else "")) for i in range(12)]
    rows += [(20, " ".join(rows[0][1].split()[5:110])), (21, "x " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, window)
    assert sorted(map(tuple, drop_repeats(df, window=window).collect()), key=str) == want
    kept = {r["doc_id"]: r["text"] for r in without_repeats(df, window=window).collect()}
    assert kept == {i: body if gone else dict(rows)[i] for i, _, gone, _, body in want}


def test_windows_shorter_than_a_gram_are_refused(spark):
    with pytest.raises(ValueError):
        drop_repeats(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), window=7)
