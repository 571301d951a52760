"""Byte-level BPE ids of whole texts through a bounded cache of the parts between blanks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import tiktoken

# Parts a worker remembers, and the longest part worth remembering (characters).
CACHE_PARTS = 1_200_000
CACHE_CHARS = 64

# A blank before a character that is not white space always starts a pre-token, so parts cut there are encoded alone.
_CUT = re.compile(r" (?=\S)")
_OTHER = re.compile(r" (?:\s|$)")
# Fixed value: how byte-level tokenizers cut a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# New parts that are encoded as one text.
TOGETHER = 10_000


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the rest for 256 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Encoder:
    """Ids as little-endian 32-bit bytes; ``tokenizer`` is the path of a tokenizers file with byte-level pre-tokens."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread in each of Spark's tasks
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges = self.model.model.tokenize  # looked up once: each look makes a new wrapper
        self.together = self._merges(tokenizer) or (lambda text: self.model.encode(text, add_special_tokens=False).ids)
        self.known: dict[str, bytes] = {}
        self.opens = np.zeros(self.model.get_vocab_size(), bool)  # tokens that begin with a blank
        for token, number in self.model.get_vocab().items():
            self.opens[number] = token.startswith(_LETTERS[32])

    @staticmethod
    def _merges(tokenizer: str) -> Callable[[str], list[int]] | None:
        """The file's merges in tiktoken, which gives the same ids several times faster; None where it might not.

        That takes byte-level pre-tokens by the usual pattern, nothing before them, and merged tokens numbered in the
        order of their merges, since tiktoken merges by the numbers.
        """
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec["pre_tokenizer"], spec["model"]
        plain = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not spec["normalizer"]
        if not plain or model["type"] != "BPE" or model.get("ignore_merges"):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [model["vocab"][a + b] for a, b in pairs]
        octets = {letter: bytes([b]) for b, letter in _LETTERS.items()}
        added = {t["content"] for t in spec["added_tokens"]}
        words = {t: n for t, n in model["vocab"].items() if t not in added}
        if merged != sorted(set(merged)) or len(merged) + 256 != len(words) or max(words[c] for c in octets) > min(merged):
            return None
        ranks = {b"".join(octets[c] for c in t): n for t, n in words.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def parts(self, text: str) -> list[str]:
        """The text cut before each blank that starts a word; all but the first part lack that blank."""
        return _CUT.split(text) if _OTHER.search(text) else text.split(" ")

    def pre_token(self, text: str) -> list[int]:
        """Ids of one pre-token, by the model's merges alone."""
        return [t.id for t in self.merges(text.encode().decode("latin-1").translate(_LETTERS))]

    def _learn(self, parts: set[str], blank: str) -> dict[str, bytes]:
        """Ids of ``blank`` and each part.

        Parts without a blank inside are encoded as one text, many at a time: there a token begins with a blank where a
        part does, and nowhere else.
        """
        found, others = {}, list(parts)
        if blank:
            whole = [p for p in others if p and blank not in p]
            others = [p for p in others if not p or blank in p]
            for start in range(0, len(whole), TOGETHER):
                some = whole[start : start + TOGETHER]
                ids = np.array(self.together(blank + blank.join(some)), "<u4")
                begins = np.flatnonzero(self.opens[ids])
                if len(begins) != len(some):  # a tokenizer that cuts otherwise
                    others += some
                    continue
                octets, ends = ids.tobytes(), (4 * np.append(begins[1:], len(ids))).tolist()
                found.update(zip(some, map(octets.__getitem__, map(slice, (4 * begins).tolist(), ends))))
        codes = self.model.encode_batch([blank + p for p in others], add_special_tokens=False)
        found.update((p, np.array(c.ids, "<u4").tobytes()) for p, c in zip(others, codes))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.parts(t) for t in texts]
        first = self._learn({c[0] for c in cut}, "")
        wanted = set().union(*cut)
        if len(self.known) > CACHE_PARTS:
            self.known.clear()
        here = self._learn(wanted.difference(self.known), " ")
        long = [p for p in here if len(p) > CACHE_CHARS]
        self.known.update(here)
        get = self.known.__getitem__
        out = [first[c[0]] + b"".join(map(get, islice(c, 1, None))) for c in cut]
        for p in long:
            del self.known[p]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """One per worker process and file."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]
