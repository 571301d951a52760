"""Token counts that follow edits: a segment tree over each document's pre-tokens, re-encoded only where edits touch.

Byte-level BPE never joins two pre-tokens, so a text's count is the sum over its pre-tokens. Leaves of a tree hold up to
``LEAF`` pre-tokens with their counts; inner nodes hold sums of characters and tokens. An edit finds its place by the
sums, takes the pre-tokens it touches with a few characters of context on the left, cuts them anew together with what
follows until a cut falls on an old one, and updates the sums on the paths of the leaves concerned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .tokens import CACHE_CHARS, CACHE_PARTS, encoder

LEAF = 64
# A pre-token's end depends on no more than this many characters after it (contractions look ahead by two), and so a
# cut before an edit stands if it is that far away.
CONTEXT = 4

EDITS = "array<struct<at:long, cut:long, put:string>>"


class Counter:
    """Pre-tokens and their token counts, with a bounded memory of counts."""

    def __init__(self, tokenizer: str, pattern: str):
        self.encoder = encoder(tokenizer)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def learn(self, parts: set[str]) -> None:
        new = list(parts.difference(self.known))
        if len(self.known) + len(new) > CACHE_PARTS:
            self.known.clear()
            new = list(parts)
        self.known.update((p, len(self.encoder.pre_token(p))) for p in new)

    def forget_long(self, parts: set[str]) -> None:
        for p in parts:
            if len(p) > CACHE_CHARS:
                self.known.pop(p, None)

    def counts(self, parts: list[str]) -> list[int]:
        if any(p not in self.known for p in parts):
            self.learn(set(parts))
        return [self.known[p] for p in parts]


class TokenTree:
    """One text's pre-tokens in leaves, and the sums of (characters, tokens, pre-tokens) above them."""

    def __init__(self, counter: Counter, parts: list[str]):
        self.counter = counter
        self.leaves = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.encoded = 0
        self._build()

    def _build(self) -> None:
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        get = self.counter.counts
        for i, leaf in enumerate(self.leaves):
            self.sums[self.width + i] = sum(map(len, leaf)), sum(get(leaf)), len(leaf)
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def total(self) -> tuple[int, int, int]:
        return tuple(self.sums[1].tolist())

    def _update(self, leaf: int) -> None:
        parts, node = self.leaves[leaf], self.width + leaf
        self.sums[node] = sum(map(len, parts)), sum(self.counter.counts(parts)), len(parts)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def _find(self, place: int) -> tuple[int, int, int]:
        """Leaf, index and first character of the pre-token that holds the character, or the end of the text."""
        if place >= self.sums[1][0]:
            return len(self.leaves) - 1, len(self.leaves[-1]), int(self.sums[1][0])
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if before + self.sums[node][0] <= place:
                before += int(self.sums[node][0])
                node += 1
        leaf = node - self.width
        for i, part in enumerate(self.leaves[leaf]):
            if before + len(part) > place:
                return leaf, i, before
            before += len(part)
        raise AssertionError("sums and leaves differ")

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replaces ``cut`` characters from ``at`` on with ``put``; places beyond the end mean the end."""
        size = int(self.sums[1][0])
        at = min(max(at, 0), size)
        cut = min(max(cut, 0), size - at)
        leaf, i, first = self._find(max(0, at - CONTEXT))
        old, ends, more = [], [], 2 * CONTEXT  # pre-tokens taken, their ends as characters after ``first``
        next_leaf, next_i = leaf, i
        while True:
            limit = at + cut - first + more
            while (not ends or ends[-1] < limit) and next_leaf < len(self.leaves):
                if next_i == len(self.leaves[next_leaf]):
                    next_leaf, next_i = next_leaf + 1, 0
                    continue
                old.append(self.leaves[next_leaf][next_i])
                ends.append((ends[-1] if ends else 0) + len(old[-1]))
                next_i += 1
            rest = "".join(old)
            whole = next_leaf >= len(self.leaves)
            text = rest[: at - first] + put + rest[at - first + cut :]
            new, place, shift = [], 0, len(put) - cut
            old_cuts = {e + shift for e in ends if e >= at - first + cut}
            stop = None
            for part in self.counter.cut(text):
                new.append(part)
                place += len(part)
                if place in old_cuts and place + CONTEXT <= len(text):
                    stop = place
                    break
            if stop is None and not whole:
                more *= 2
                continue
            break
        self.encoded += place
        kept = len(old) if stop is None else ends.index(stop - shift) + 1
        self._splice(leaf, i, kept, new)

    def _splice(self, leaf: int, i: int, count: int, new: list[str]) -> None:
        own, touched = self.leaves[leaf], [leaf]
        gone = min(count, len(own) - i)
        tail, count = own[i + gone :], count - gone
        own[i:] = []
        later = leaf
        while count:
            later += 1
            gone = min(count, len(self.leaves[later]))
            del self.leaves[later][:gone]
            count -= gone
            touched.append(later)
        own += [*new, *tail]
        if len(own) > 4 * LEAF:  # grown too far: leaves are dealt anew
            parts = [p for x in self.leaves for p in x]
            self.leaves = [parts[j : j + LEAF] for j in range(0, len(parts), LEAF)] or [[]]
            self._build()
            return
        for x in touched:
            self._update(x)

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


def with_edits(df: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` with a column ``edits`` from a table (key, step, at, cut, put), in the order of step.

    Documents without edits get null. A document's own edits are gathered in its row. Rows with a null key get none.
    """
    own = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", "at", "cut", "put"))).alias("edits"))
    bare = F.transform("edits", lambda e: F.struct(e["at"].alias("at"), e["cut"].alias("cut"), e["put"].alias("put")))
    return df.join(own.select(key, bare.cast(EDITS).alias("edits")), key, "left")


def edited_counts(
    df: DataFrame, edits: Column | str, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, tokens_before, tokens, pre_tokens, chars, chars_encoded, text_sha256, steps) per row.

    ``edits`` is an array of (at, cut, put), applied in order, each to the text as the last has left it; characters are
    code points. ``tokens`` counts the text after all edits, ``steps`` after each; ``chars_encoded`` is how many
    characters the edits had encoded anew. A null text is empty. Null or empty edits change nothing; in an edit a null
    place is the end, a null cut 0 and a null put empty; places are held within the text. No row moves. Repeated rows
    give repeated results, other columns are ignored, no rows give no rows.
    """
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    edits = F.col(edits) if isinstance(edits, str) else edits
    source = df.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), edits.cast(EDITS).alias("edits")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer, pattern)
        for rows in chunks(batches):
            texts = rows.column(1).to_pylist()
            cut = [counter.cut(t) for t in texts]
            every = set().union(*cut)
            counter.learn(every)
            out = []
            for parts, own in zip(cut, rows.column(2).to_pylist()):
                tree = TokenTree(counter, parts)
                before, steps = tree.total[1], []
                for e in own or ():
                    if e is not None:
                        place = tree.total[0] if e["at"] is None else e["at"]
                        tree.edit(place, e["cut"] or 0, e["put"] or "")
                    steps.append(tree.total[1])
                chars, tokens, count = tree.total
                digest = hashlib.sha256(tree.text().encode()).hexdigest()
                out.append((before, tokens, count, chars, tree.encoded, digest, steps))
            counter.forget_long(every)
            kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64())]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=NAMES)

    shape = "tokens_before long, tokens long, pre_tokens long, chars long, chars_encoded long, text_sha256 string, steps array<long>"
    return source.mapInArrow(run, f"doc_id {kind}, {shape}")


NAMES = ["doc_id", "tokens_before", "tokens", "pre_tokens", "chars", "chars_encoded", "text_sha256", "steps"]
