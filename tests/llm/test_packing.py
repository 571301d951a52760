import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import tokens
from tidegauge.llm.packing import Packer, Run, pack
from tidegauge.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check(rows, documents, model, tokens, segments, loss, prompts=None):
    """Each id in one piece, sequences gapless and within every limit; returns the sequences' lengths."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for i, t in documents:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, len(ids)].append(ids)
    assert pieces.keys() == want.keys()
    for key, texts in want.items():
        got = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces[key])
        if len(texts) == 1:
            at = 0
            for start, length, crc in got:
                assert start == at and length > 0
                assert crc == zlib.crc32(np.array(texts[0][at : at + length], "<u4").tobytes())
                at += length
            assert at == key[1]
        else:
            assert sum(length for _, length, _ in got) == key[1] * len(texts)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own]).tolist()
        assert [r["offset"] for r in own] == [0, *ends[:-1]]
        assert ends[-1] <= tokens and len(own) <= segments and sum(r["loss_tokens"] for r in own) <= loss
    return [sum(r["length"] for r in own) for own in sequences.values()]


def test_messy(messy, messy_rows, nothing, model):
    documents = [(r[0], r[1]) for r in messy_rows]
    for limits in ((1024, 256, 1024), (64, 2, 64), (64, 9, 40), (1, 1, 1)):
        check(pack(messy, PATH, *limits).collect(), documents, model, *limits)
    assert pack(nothing, PATH).collect() == []


def test_no_padding_to_speak_of(small, model):
    documents = [tuple(r) for r in small.select("doc_id", "text").collect()]
    lengths = check(pack(small, PATH).collect(), documents, model, 1024, 256, 1024)
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths)


def test_prompts_bear_no_loss_and_ids_come_along(spark, model):
    rows = [(i, "word " * (i * 7 % 90), None if i % 5 == 0 else i % 40) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt long").repartition(2)
    out = pack(df, PATH, 128, 6, 70, prompt="prompt", with_ids=True).collect()
    check(out, [r[:2] for r in rows], model, 128, 6, 70)
    quiet = {i: q or 0 for i, _, q in rows}
    for r in out:
        assert len(r["ids"]) == r["length"]
        assert r["loss_tokens"] == max(0, r["start"] + r["length"] - max(quiet[r["doc_id"]], r["start"]))


def test_the_run_with_the_largest_dot_product_goes_first():
    packer = Packer(100, 10, 50, 0)
    for name, length, quiet in (("a", 40, 40), ("b", 40, 0), ("c", 60, 60)):
        list(packer.add(Run(name, b"\0" * 4 * length, 0, length, quiet, length)))
    placed = [(s, o, r.name, r.length) for s, o, r in packer.fill()]
    # b asks for 0.4 of the tokens and 0.8 of the loss; then c is the longest that fits.
    assert placed == [(0, 0, "b", 40), (0, 40, "c", 60)]


def test_parts_between_blanks_encode_like_whole_texts(model):
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b\n\n c ", "\ta  b  c  d", "it's we'll  'll ' s",
             "x\x1c y \x1fz", "中文 字 \U0001f600 \U0001f600", "<|endoftext|> a<|endoftext|>", "1 22 333 ...  !!! \r\n", "é é ​ z",
             "w" * 5000 + " " + "v " * 3000, " ".join(f"n{i}" for i in range(3000))]
    encoder = Encoder(PATH)
    for _ in range(2):
        for ids, text in zip(encoder.encode(texts), texts):
            assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_new_parts_are_encoded_together_as_alone(monkeypatch):
    """Whatever is cached and however many parts go together, the ids are the tokenizer's own."""
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    draw = random.Random(3)
    texts = ["", " ", "a", " a", "a ", "a  b", "x\n y", "x \n\n z", "<|endoftext|> b <|endoftext|>", "Ġ Ġa Ċ", "it's 'll don't 12 3,4 !? . .."]
    texts += ["".join(draw.choice(" a\n\t.'é中0\U0001f600　Ġ") for _ in range(n)) for n in (10, 100, 3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    for together in (1, 3, 10_000):
        monkeypatch.setattr(tokens, "TOGETHER", together)
        assert tokens.Encoder(PATH).encode(texts) == want
    slow = tokens.Encoder(PATH)
    assert slow._merges(PATH) is not None
    slow.together = lambda text: model.encode(text, add_special_tokens=False).ids
    assert slow.encode(texts) == want
