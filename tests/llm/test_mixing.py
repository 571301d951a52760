import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import common, mixing
from tidegauge.llm.mixing import mixed, source_targets, with_copies, word_count

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return len(WORD.findall(text or ""))


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, stop at the cap, share the excess anew among the rest, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    full = set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        share = {s: Fraction(weight[s] * rest, sum(weight[o] for o in open_)) for s in open_}
        above = {s for s in open_ if share[s] > cap * sizes[s]}
        if not above:
            return {s: share.get(s, Fraction(cap * sizes[s])) for s in names}
        full |= above


def brute(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    targets, out = brute_targets(sizes), []
    for doc, text, source in rows:
        name = "" if doc is None and text is None else f"text:{text}" if doc is None else str(doc)
        draw = int(hashlib.md5(f"mix:{name}".encode()).hexdigest()[:13], 16) / 2**52
        rate = float(targets[source]) / sizes[source] if sizes[source] else 0.0
        out.append((doc, words(text), sizes[source], float(targets[source]), int(rate) + (draw < rate - int(rate))))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in with_copies(df).select("doc_id", "size", "source_size", "target", "copies").collect()), key=str)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_messy(messy, monkeypatch):
    want = brute(rows_of(messy))
    assert got(messy) == want
    monkeypatch.setattr(common, "FACT_ROWS", 1)  # the way of many sources: large ones by broadcast, the rest shuffled
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    monkeypatch.setattr(mixing, "SOURCES_PER_PART", 2)
    assert got(messy) == want


def test_given_documents(small):
    assert got(small) == brute(rows_of(small))


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1, "b": 1000, "c": 10, None: 7},
        {"a": 0, "b": 0},
        {"a": 0, "b": 5},
        {str(n): (n * 37) % 101 for n in range(60)},
        {"z": 3, "Z": 300, "é": 20, "\U0001f600": 5, "￮": 50},  # by code points, not by UTF-16 units
    ],
)
def test_targets(spark, sizes):
    rows = [(s, " ".join(["w"] * n)) for s, n in sizes.items()]
    found = source_targets(spark.createDataFrame(rows, "source string, text string"), word_count(F.col("text"))).collect()
    want = brute_targets(sizes)
    assert {r["source"]: r["target"] for r in found} == pytest.approx({s: float(t) for s, t in want.items()})
    assert all(r["target"] <= 3 * r["source_size"] for r in found)


def test_taken_words_come_near_the_targets(spark):
    rows = [(n, " ".join(["w"] * (1 + n * 7 % 90)), f"s{n % 9 if n % 3 else 0}") for n in range(30_000)]
    found = with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sums = found.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.05 * r["target"] for r in sums)


def test_copies_are_rows(messy):
    taken = {(r["doc_id"], r["text"]): r["copies"] for r in with_copies(messy).collect()}
    seen = {}
    for r in mixed(messy).collect():
        seen.setdefault((r["doc_id"], r["text"]), []).append(r["copy"])
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert all(sorted(seen.get(k, [])) == sorted(list(range(1, taken[k] + 1)) * rows.count(k)) for k in set(rows))


def test_empty(nothing):
    assert got(nothing) == []
