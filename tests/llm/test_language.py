from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import language_id
from tidegauge.llm.language_id import classify, fit_profiles, predict, prediction


def grams(text):
    """n -> Counter of grams over letters, all else one blank."""
    run = " "
    for c in text.lower() + " ":
        c = c if c.isalpha() else " "
        if not (c == " " and run[-1] == " "):
            run += c
    return {
        n: Counter(g for i in range(len(run) - n + 1) if (g := run[i : i + n]) != " ")
        for n in range(1, language_id.LONGEST + 1)
    }


def top(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][: language_id.PROFILE]


def brute_profiles(rows):
    total = {}
    for lang, text in rows:
        if any(c.isalpha() for c in text):
            for n, c in grams(text).items():
                total.setdefault((lang, n), Counter()).update(c)
    out = {}
    for (lang, _), c in total.items():
        out.setdefault(lang, {}).update({g: r for r, g in enumerate(top(c))})
    return out


def brute(text, profiles):
    if text is None or not any(c.isalpha() for c in text) or not profiles:
        return "und", 0.0
    best = None
    own = [top(c) for c in grams(text).values()]
    for lang in sorted(profiles):
        far = sum(
            min(language_id.PROFILE, abs(profiles[lang].get(g, 10**9) - r)) for ranks in own for r, g in enumerate(ranks)
        )
        if best is None or far < best[0]:
            best = far, lang
    return best[1], 1 - best[0] / (language_id.PROFILE * sum(map(len, own)))


def test_profiles_and_distances_against_brute_force(small):
    rows = [tuple(r) for r in small.select("lang", "text").collect()]
    profiles = fit_profiles(small.repartition(3))
    assert profiles == brute_profiles([r for r in rows if None not in r])
    texts = [t for _, t in rows]
    names, scores = classify([t.encode() for t in texts], profiles)
    want = [brute(t, profiles) for t in texts]
    assert names == [n for n, _ in want]
    assert scores.tolist() == pytest.approx([s for _, s in want])


def test_messy(messy, messy_rows, nothing):
    profiles = fit_profiles(messy)
    assert profiles == brute_profiles([(r[2], r[1]) for r in messy_rows if r[1] and r[2]])
    got = sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in predict(messy, profiles).collect()), key=str)
    want = [(r[0], *brute(r[1], profiles)) for r in messy_rows]
    assert got == sorted(((i, n, round(s, 9)) for i, n, s in want), key=str)
    beside = messy.withColumn("p", prediction(F.col("text"), profiles, messy.sparkSession)).collect()
    assert sorted(((r["doc_id"], r["p"]["lang_pred"]) for r in beside), key=str) == [(i, n) for i, n, _ in got]
    assert predict(nothing, profiles).collect() == [] and fit_profiles(nothing) == {}
    assert {r["lang_pred"] for r in predict(messy, {}).collect()} == {"und"}


@pytest.mark.parametrize("most", [1, 5, 40])
def test_sample_is_of_least_hashes(spark, monkeypatch, most):
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANG", most)
    rows = [(i, f"{'abcdefghij'[i % 10]} {i % 60}{'xyzuvw'[i % 6] * (i % 9)}", "ab"[i % 5 == 0]) for i in range(120)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    drawn = df.withColumn("draw", F.xxhash64(F.lit("profile"), "doc_id", F.col("text").cast("binary"))).collect()
    want = []
    for lang in "ab":
        own = sorted((r for r in drawn if r["lang"] == lang), key=lambda r: r["draw"])
        want += [(lang, r["text"]) for r in own if r["draw"] <= own[min(most, len(own)) - 1]["draw"]]
    assert fit_profiles(df.repartition(5)) == brute_profiles(want)


def test_wide_alphabets_go_in_smaller_parts():
    texts = ["".join(map(chr, range(0x4E00 + 400 * i, 0x4E00 + 400 * i + 400))).encode() for i in range(40)]
    texts += ["".join(map(chr, range(0x3400, 0x9FFF))).encode(), b"plain words", None]
    profiles = brute_profiles([("zh", "".join(map(chr, range(0x4E00, 0x5000)))), ("en", "plain words in a row")])
    names, scores = classify(texts, profiles)
    want = [brute(t.decode() if t else None, profiles) for t in texts]
    assert names == [n for n, _ in want] and scores.tolist() == pytest.approx([s for _, s in want])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = predict(docs.where(held), fit_profiles(docs.where(~held))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_without_labels_the_stage_keeps_texts_with_letters(spark):
    import corpus_pipeline

    rows = [(1, "plain words", None), (2, "12 !?", None), (3, "中文", None), (4, None, None), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = [r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()]
    assert sorted(kept, key=str) == [1, 3, None]
