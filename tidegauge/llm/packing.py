"""Vector bin packing of token runs: the dot-product heuristic under limits on tokens, segments and loss tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .tokens import encoder

END = 0
# Runs a task weighs against each other; they are all that it holds besides the rows at hand.
WAITING = 128


@dataclass
class Run:
    """What is left of a document's ids. The first ``quiet`` ids bear no loss."""

    name: object
    ids: bytes
    start: int
    length: int
    quiet: int
    total: int

    def loss(self, length: int) -> int:
        return max(0, length - self.quiet)

    def cut(self, length: int) -> "Run":
        """Takes the first ``length`` ids off this run."""
        head = Run(self.name, self.ids[: 4 * length], self.start, length, min(self.quiet, length), self.total)
        self.ids, self.start, self.length = self.ids[4 * length :], self.start + length, self.length - length
        self.quiet = max(0, self.quiet - length)
        return head


class Packer:
    """Fills one sequence at a time from the runs that wait.

    Of the runs that fit, the one whose demands (tokens, one segment, loss tokens, each as a share of its limit) have
    the largest dot product with what is left of the sequence goes in. When none fits, the longest is cut to fill the
    rest exactly, so a sequence ends short only at the segment or loss limit or when no run waits.
    """

    def __init__(self, tokens: int, segments: int, loss: int, first: int):
        self.limit = np.array([tokens, segments, loss], np.float64)
        self.waiting: list[Run] = []
        self.need = np.zeros((0, 3))
        self.next = first

    def add(self, run: Run) -> Iterator[tuple[int, int, Run]]:
        tokens, _, loss = self.limit
        while run.length >= tokens and run.loss(int(tokens)) <= loss:  # a whole sequence of its own
            yield self.next, 0, run.cut(int(tokens))
            self.next += 1
        if run.length:
            self.waiting.append(run)
            self.need = np.vstack((self.need, [run.length, 1, run.loss(run.length)]))
        while len(self.waiting) > WAITING:
            yield from self.fill()

    def _take(self, at: int) -> Run:
        self.need = np.delete(self.need, at, axis=0)
        return self.waiting.pop(at)

    def fill(self) -> Iterator[tuple[int, int, Run]]:
        left, offset = self.limit.copy(), 0
        while self.waiting and left[0] >= 1 and left[1] >= 1:
            fits = (self.need <= left).all(axis=1)
            if fits.any():
                value = (self.need / self.limit) @ (left / self.limit)
                run = self._take(int(np.argmax(np.where(fits, value, -1.0))))
            else:
                room = np.array([min(left[0], r.length, r.quiet + left[2]) for r in self.waiting])
                at = int(np.argmax(np.where(room > 0, self.need[:, 0], -1.0)))
                if room[at] < 1:
                    break
                run = self.waiting[at].cut(int(room[at]))
                rest = self.waiting[at]
                self.need[at] = rest.length, 1, rest.loss(rest.length)
            left -= (run.length, 1, run.loss(run.length))
            yield self.next, offset, run
            offset += run.length
        self.next += 1

    def finish(self) -> Iterator[tuple[int, int, Run]]:
        """Fills while runs wait; the ids short of a whole sequence go to sequences of a power of two, without padding."""
        tokens = int(self.limit[0])
        while self.waiting:
            rest = int(self.need[:, 0].sum())
            if rest < tokens:
                whole, self.limit[0] = self.limit[0], 1 << (rest.bit_length() - 1)
                yield from self.fill()
                self.limit[0] = whole
            else:
                yield from self.fill()


def pack(
    df: DataFrame,
    tokenizer: str,
    tokens: int = 1024,
    segments: int = 256,
    loss: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Every id of every text in sequences of at most ``tokens`` ids, ``segments`` pieces and ``loss`` loss ids.

    A document is the ids of its whole text and then the id 0; a null text is empty. ``prompt`` names a column with the
    number of leading ids that bear no loss (null: none); ``loss`` left open is ``tokens``. Returns a row per piece:
    doc_id, start, length, ids_crc32 (little-endian 32-bit ids), doc_tokens, sequence_id, offset, loss_tokens and, if
    asked, ids. Each input partition packs its own rows with a bounded set of waiting runs, so nothing is shuffled; a
    sequence_id holds the partition's number and a count. Sequences shorter than ``tokens`` are those at another limit
    and, per partition, one for each binary digit of its rest. Repeated rows and null ids are documents like any other;
    other columns are ignored. No rows give no rows.
    """
    limit = tokens if loss is None else loss
    if min(tokens, segments, limit) < 1:
        raise ValueError("every limit must be 1 or more")
    kind = df.select(F.col(key)).schema[0].dataType
    quiet = F.lit(0) if prompt is None else F.greatest(F.coalesce(F.col(prompt), F.lit(0)), F.lit(0))
    source = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), quiet.cast("long").alias("quiet"))
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        packer = Packer(tokens, segments, limit, TaskContext.get().partitionId() << 40)
        shape = None

        def rows(pieces: list[tuple[int, int, Run]]) -> pa.RecordBatch:
            columns = {
                "doc_id": pa.array([r.name for *_, r in pieces], shape),
                "start": pa.array([r.start for *_, r in pieces], pa.int64()),
                "length": pa.array([r.length for *_, r in pieces], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(r.ids) for *_, r in pieces], pa.int64()),
                "doc_tokens": pa.array([r.total for *_, r in pieces], pa.int64()),
                "sequence_id": pa.array([s for s, *_ in pieces], pa.int64()),
                "offset": pa.array([o for _, o, _ in pieces], pa.int64()),
                "loss_tokens": pa.array([r.loss(r.length) for *_, r in pieces], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(r.ids, "<u4").astype(np.int32) for *_, r in pieces], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(columns)

        for part in chunks(batches):
            shape, pieces = part.column(0).type, []
            names, quiets = part.column(0).to_pylist(), part.column(2).to_pylist()
            for name, ids, q in zip(names, encode(part.column(1).to_pylist()), quiets):
                total = len(ids) // 4 + 1
                pieces += packer.add(Run(name, ids + end, 0, total, q, total))
            yield rows(pieces)
        if shape is not None:
            yield rows(list(packer.finish()))

    out = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    return source.mapInArrow(run, out + (", ids array<int>" if with_ids else ""))
