import random
import re

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tidegauge.llm import piece_lattice
from tidegauge.llm.piece_lattice import Pieces, decode, encode, totals

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(PATH)


@pytest.fixture(scope="module")
def library():
    """The library's own Viterbi search over the same pieces and scores."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:  # a lone mark costs 10^9, beside which the library's 32-bit sums lose all else
        piece.score = max(piece.score, -50_000)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


_TABLES = {}


def _table(pieces):
    return _TABLES.setdefault(id(pieces), {p: (i, s) for p, i, s in pieces.rows})


def brute(text, pieces):
    """Viterbi over the text's words, one after the other; of short texts also over the whole, with the same result."""
    table = _table(pieces)
    out, marked = [], "▁" + text.replace(" ", "▁") if text else ""
    words, word = [], ""
    for c in marked:
        if c == "\n" or word == "\n" or (c == "▁" and word[-1:] != "▁"):  # a run of blanks stays with the word after it
            words.append(word)
            word = ""
        word += c
    for w in filter(None, [*words, word]):
        best = [(0.0, None)] + [None] * len(w)
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + pieces.longest) + 1):
                found = table.get(w[i:j]) or ((None, pieces.unknown) if j == i + 1 else None)
                if found and (best[j] is None or best[i][0] + found[1] > best[j][0]):
                    best[j] = best[i][0] + found[1], (i, found[0])
        path, at = [], len(w)
        while at:
            start, number = best[at][1]
            path.append([pieces.bytes[b] for b in w[start:at].encode()] if number is None else [number])
            at = start
        out += [x for part in reversed(path) for x in part]
    assert len(text) > 2000 or out == (brute_whole(text, pieces) if text else [])
    return out


def check(df, rows, pieces):
    got = encode(df, pieces)
    want = [(i, None if t is None else brute(t, pieces)) for i, t in rows]
    assert sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=str) == sorted(want, key=str)
    back = sorted(((r["doc_id"], r["text"]) for r in decode(got, pieces).collect()), key=str)
    assert back == sorted(rows, key=str)


@pytest.mark.parametrize("bound", [0, 5, 300_000])
def test_given_documents(spark, small, pieces, library, bound, monkeypatch):
    """The same ids whichever words are broadcast; the library's search gives them too."""
    monkeypatch.setattr(piece_lattice, "BROADCAST_WORDS", bound)
    docs = small.limit(40)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(df, rows, pieces)
    if bound == 0:
        plain = [line for _, t in rows for line in t.split("\n") if line and "  " not in line]
        plain = [line for line in plain if not set(brute(line, pieces)) & set(pieces.bytes)]
        assert len(plain) > 100
        for line in plain:
            assert library.encode(line) == brute(line, pieces), line


def test_messy(spark, messy, messy_rows, pieces, nothing):
    short = messy.where("doc_id is null or doc_id not in (11, 12)")
    rows = [(r[0], r[1]) for r in messy_rows if r[0] not in (11, 12)]
    check(short, rows, pieces)
    assert encode(nothing, pieces).collect() == [] and totals(nothing, pieces).collect() == []


def test_long_words(spark, pieces):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcdefgh12中é\U0001f600") for _ in range(n))) for i, n in enumerate((63, 64, 65, 129, 1500))]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, pieces)


def test_a_text_that_is_one_word_of_a_third_of_a_million_characters(spark, pieces):
    rng = random.Random(2)
    rows = [(1, "".join(rng.choice("abcdefgh12中é😀") for _ in range(300_000))), (2, "short one"), (3, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    check(df, rows, pieces)
    assert all(r["round_trip"] for r in totals(df, pieces).collect())


def test_totals(messy, messy_rows, pieces):
    got = totals(messy, pieces).collect()
    assert all(r["round_trip"] for r in got)
    numbers = sorted(((r["doc_id"], r["n_pieces"]) for r in got), key=str)
    assert numbers == sorted(((r[0], len(brute(r[1] or "", pieces))) for r in messy_rows), key=str)
    twice = [r for r in got if r["doc_id"] == 15]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert len({r["digest"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert len({r["digest"] for r in got if r["doc_id"] in (1, 3)}) == 2


def brute_whole(text, pieces):
    """Viterbi over the whole text at once, no word cut: (cost, ids)."""
    table, w = _table(pieces), "▁" + text.replace(" ", "▁")
    best = [(0.0, None)] + [None] * len(w)
    for i in range(len(w)):
        for j in range(i + 1, min(len(w), i + pieces.longest) + 1):
            found = table.get(w[i:j]) or ((None, pieces.unknown) if j == i + 1 else None)
            if found and (best[j] is None or best[i][0] + found[1] > best[j][0]):
                best[j] = best[i][0] + found[1], (i, found[0])
    path, at = [], len(w)
    while at:
        start, number = best[at][1]
        path.append([pieces.bytes[b] for b in w[start:at].encode()] if number is None else [number])
        at = start
    return [x for part in reversed(path) for x in part]


def test_runs_of_blanks(spark, pieces, library):
    """Pieces of several marks are edges too: the best segmentation of the whole text, and the library's."""
    lines = [f"{lead}{' ' * n}def name{' ' * (n % 5 + 1)}= value" for n in range(1, 14) for lead in ("", "if x:")]
    for line in lines:
        assert library.encode(line) == brute_whole(line, pieces), line
    texts = [*lines, "    def", " \t\n \u000b ", "a     ", "     ", "a\n    b\n\n        c  \n", "|  a  |   bb   |", "x▁▁▁ ▁y", " " * 200 + "z"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"], r["ids"]) for r in encode(df, pieces).collect()) == [(i, brute_whole(t, pieces)) for i, t in rows]
    n = {r["doc_id"]: r["n_pieces"] for r in totals(df, pieces).collect()}
    assert n == {i: len(brute_whole(t, pieces)) for i, t in rows}


def test_words_are_folded_where_they_are(spark, pieces):
    """No shuffle, sort or grouping between a word and its pieces; few edges a batch cut words anywhere."""
    words = ["▁", "\n", "▁▁▁x", "▁naïve中😀", "▁" + "ab1" * 21, "▁reproducible"] + [f"▁word{i}é{i * i}" for i in range(300)]
    keyed = spark.createDataFrame([(w, w) for w in words], "key string, word string").repartition(2)
    solved = piece_lattice.solve(keyed, pieces)
    plan = solved._jdf.queryExecution().executedPlan().toString()
    assert "SortExec" not in plan and "HashAggregate" not in plan and plan.count("hashpartitioning") == 0
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["key"]: (r["ids"], r["unknown"], r["whole"]) for r in solved.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    octets = set(pieces.bytes)
    for w in words:
        if w in ("▁", "\n"):  # the brute force reads texts, and these are none
            continue
        best = brute(w[1:].replace("▁", " "), pieces)
        assert got[w] == (best, sum(i in octets for i in best), True), w
    assert len(got) == len(words) and all(whole for *_, whole in got.values())


def test_words_and_occurrences_share_one_shuffle_whatever_the_thinned_copy_holds(spark, pieces, monkeypatch):
    long = "ab" * 60
    texts = [f"the word {i % 7} of {long} and {long}x\n" + "often " * (i % 5) for i in range(40)] + ["", None, " ", long]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for share in (0.0, 1.0):
        monkeypatch.setattr(piece_lattice, "THINNED", share)
        out = totals(rows, pieces)
        found.append(sorted(tuple(r) for r in out.collect()))
        assert "ReusedExchange" in re.sub(r"ReusedExchange[^\n]*Broadcast", "", out._jdf.queryExecution().executedPlan().toString())
    assert found[0] == found[1] and len(found[0]) == len(texts) and all(r[-1] for r in found[0])
