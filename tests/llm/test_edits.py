import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import edit_counts
from tidegauge.llm.edit_counts import Counter, TokenTree, edited_counts, with_edits
from tidegauge.llm.query_edits import REVISION

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def count():
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def replaced(text, at, cut, put):
    at = min(max(len(text) if at is None else at, 0), len(text))
    return text[:at] + (put or "") + text[at + max(cut or 0, 0) :]


@pytest.mark.parametrize("seed", range(6))
def test_every_edit_against_a_count_from_the_start(count, seed, monkeypatch):
    """Small leaves, and texts of the characters on which cuts depend."""
    monkeypatch.setattr(edit_counts, "LEAF", 3 + seed)
    rng, counter = random.Random(seed), Counter(PATH, PATTERN)
    alphabet = "ab'lvestdrm  \n\t19.,!é中 "
    text = "".join(rng.choice(alphabet) for _ in range(rng.choice((0, 5, 400))))
    tree = TokenTree(counter, counter.cut(text))
    for _ in range(150):
        at, cut = rng.randint(-3, len(text) + 3), rng.choice((0, 0, 1, 2, 5, 60))
        put = "".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 2, 3, 30))))
        tree.edit(at, cut, put)
        text = replaced(text, at, cut, put)
        assert tree.text() == text
        parts = counter.cut(text)
        assert [p for leaf in tree.leaves for p in leaf] == parts
        assert tree.total == (len(text), count(text), len(parts))


def test_only_the_region_is_encoded():
    counter = Counter(PATH, PATTERN)
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = TokenTree(counter, counter.cut(text))
    for at in (0, 50_000, len(text) - 5):
        tree.edit(at, 3, "changed")
    assert tree.encoded < 200


def test_messy(messy, messy_rows, nothing, count):
    out = edited_counts(messy, F.expr(REVISION), PATH, PATTERN).collect()
    want = []
    for i, text, lang, source, *_ in messy_rows:
        body, steps = text or "", []
        if text is not None:
            for at, cut, put in (
                (len(text) // 3, 24, text[:40]),
                (len(text) // 2, 0, f" {lang or ''}'ll "),
                (len(text) // 5, 60, ""),
                (None, 0, "\n" + (source or "")),
            ):
                body = replaced(body, at, cut, put)
                steps.append(count(body))
        else:
            for put in ("", f" {lang or ''}'ll ", "", "\n" + (source or "")):
                body += put
                steps.append(count(body))
        want.append((i, count(text or ""), count(body), len(body), hashlib.sha256(body.encode()).hexdigest(), steps))
    got = [tuple(r[c] for c in ("doc_id", "tokens_before", "tokens", "chars", "text_sha256", "steps")) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert edited_counts(nothing, F.expr(REVISION), PATH, PATTERN).collect() == []


def test_edits_from_a_table(spark, count):
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (3, None), (None, "x")], "doc_id long, text string")
    rows = [(1, 2, 0, 3, "1"), (1, 1, 3, 0, " and"), (3, 1, 0, 0, "new"), (2, 1, None, None, None), (9, 1, 0, 0, "lost")]
    edits = spark.createDataFrame(rows, "doc_id long, step int, at long, cut long, put string")
    out = edited_counts(with_edits(docs, edits), "edits", PATH, PATTERN).collect()
    texts = {1: "1 and two", 2: "three", 3: "new", None: "x"}
    assert {r["doc_id"]: r["text_sha256"] for r in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert {r["doc_id"]: r["tokens"] for r in out} == {i: count(t) for i, t in texts.items()}


def test_given_documents(small, count):
    out = edited_counts(small, F.expr(REVISION), PATH, PATTERN)
    texts = {r["doc_id"]: r for r in small.collect()}
    for r in out.collect():
        t = texts[r["doc_id"]]
        body = replaced(t["text"], len(t["text"]) // 3, 24, t["text"][:40])
        body = replaced(body, len(t["text"]) // 2, 0, f" {t['lang']}'ll ")
        body = replaced(replaced(body, len(t["text"]) // 5, 60, ""), None, 0, "\n" + t["source"])
        assert (r["tokens_before"], r["tokens"]) == (count(t["text"]), count(body))
