import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import test_fm_dedup
import test_line_dedup
import test_simhash

import corpus_pipeline as pipeline


def test_stages_against_brute_force(spark, tmp_path):
    passage = " ".join(f"p{c}" for c in "abcdefghijklmnopqrstuvwxyzabcd")
    rows = [(i, f"menu line\n{passage if i % 3 == 0 else ''} text{i} " + " ".join(f"w{i}x{j}" for j in range(60)), "en", "s", 1) for i in range(12)]
    rows += [(20, rows[1][1], "en", "s", 1), (21, "12 !?", "en", "s", 1), (22, None, None, None, None), (None, "no id here", "en", None, 1)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, shape).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs, outputs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for number, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert number == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        outputs.append(docs.collect())
    have = [(r[0], r[1], r[3]) for r in rows if r[0] not in (21, 22)]
    pairs = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows), key=str)
    assert pairs(outputs[0]) == sorted(((i, t) for i, t, _ in have), key=str)
    texts = test_line_dedup.brute([(s, t) for _, t, s in have], 0.1, 5)
    lines = [(i, t) for (i, *_), t in zip(have, texts)]
    assert pairs(outputs[1]) == sorted(lines, key=str)
    groups = test_simhash.brute_resemblance(lines)
    stay = {i for i, c in groups if i is None or i == c}
    near = [(i, t) for i, t in lines if i in stay]
    assert 20 not in stay and pairs(outputs[2]) == sorted(near, key=str)
    want = {i: kept if gone else dict(near)[i] for i, _, gone, _, kept in test_fm_dedup.brute(near)}
    assert pairs(outputs[3]) == sorted(want.items(), key=str)
    tokens = {r["doc_id"]: r["doc_tokens"] for r in outputs[4]}
    assert tokens.keys() == want.keys()
    assert sum(r["length"] for r in outputs[4]) == sum(tokens.values())
