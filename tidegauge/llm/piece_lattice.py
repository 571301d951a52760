"""SentencePiece encoding as a relational lattice.

A text is a row of words: blanks become the mark U+2581, the first mark of a run opens a word, a newline is a word by
itself. Pieces may be several marks, but in none does a mark follow another character, so no piece spans two words and
the best segmentation of a text is that of its words. The substrings of a word up to the longest piece's
length are exploded and joined with the piece table; those found are the edges of the word's lattice. A Viterbi search
folds the stream of edges, one word after the other. A character without a piece is an edge of its own that
costs 10 more than the worst piece, written as its UTF-8 bytes.

Each word is solved once, not at each of its occurrences. The words most frequent in a thinned copy of the texts, as many
as a checked bound allows, are solved first and broadcast to the occurrences; occurrences of all others, whatever the copy
missed, go to their word in one shuffle, from which the words to solve are taken too. So the texts are split once, and the
thinned copy decides only which way a word takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

MARK = "▁"
UNKNOWN_COST = 10.0
UNKNOWN = -1
# Words that may be broadcast with their pieces: some dozen MB.
BROADCAST_WORDS = 300_000
# The share of the texts in which words are counted to choose those; no result depends on it.
THINNED = 1 / 16
# Longer words are keyed by their SHA-256, and cut in slices of this many characters before substrings are taken.
SHORT = 64


@dataclass(frozen=True)
class Pieces:
    """A model's normal pieces as rows, the ids of its byte pieces, and bounds."""

    rows: list[tuple[str, int, float]]
    bytes: list[int]
    longest: int
    unknown: float
    names: list[str]

    @classmethod
    def load(cls, model: str) -> "Pieces":
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=model)
        ids = range(m.get_piece_size())
        odd = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
        rows = [(m.id_to_piece(i), i, float(m.get_score(i))) for i in ids if not odd(i)]
        inner = [p for p, *_ in rows if MARK in p.lstrip(MARK) or "\n" in p[1:] or "\n" in p[:-1]]
        if inner:
            raise ValueError(f"{len(inner)} pieces span words")
        octets = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(m.is_byte(i) for i in octets):
            raise ValueError("the model has no byte pieces")
        worst = min(s for *_, s in rows)
        return cls(rows, octets, max(len(p) for p, *_ in rows), worst - UNKNOWN_COST, [m.id_to_piece(i) for i in ids])

    def table(self, spark: SparkSession) -> DataFrame:
        """The piece table: one row a piece, a fixed size whatever the corpus."""
        return spark.createDataFrame(self.rows, "piece string, id int, score double")


def words(text: Column) -> Column:
    """A text's words in order; their concatenation is the text with a leading mark. Null and empty texts have none."""
    # After the first step blanks only separate, so one literal character splits the text.
    marked = F.replace(F.replace(text, F.lit(MARK), F.lit(" ")), F.lit(" "), F.lit(" " + MARK))
    opened = F.concat(F.lit(MARK), marked)
    for _ in range(2):  # the first joins the marks of a run in pairs, the second the pairs
        opened = F.replace(opened, F.lit(f"{MARK} {MARK}"), F.lit(MARK + MARK))
    apart = F.replace(opened, F.lit("\n"), F.lit(" \n "))
    return F.when(text != "", F.array_remove(F.split(apart, " ", -1), ""))


def _key(word: Column) -> Column:
    return F.when(F.length(word) <= SHORT, word).otherwise(F.concat(F.lit("#"), F.sha2(word, 256)))


def _edges(keyed: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, start, stop, id, score, letter) from (key, word) with distinct keys, the edges of a word by start.

    Only a word's first edge names its key. A character without a piece is an edge with the id ``UNKNOWN`` and that
    ``letter``.
    """
    reach = pieces.longest
    slices = keyed.select("key", "word", F.explode(F.expr(f"sequence(0, length(word) - 1, {SHORT})")).alias("base")).select(
        "key", "base", F.expr(f"substring(word, base + 1, {SHORT + reach - 1})").alias("slice")
    )
    begins = slices.withColumn("i", F.explode(F.expr(f"sequence(1, least({SHORT}, length(slice)))")))
    spans = begins.withColumn("n", F.explode(F.expr(f"sequence(1, least({reach}, length(slice) - i + 1))")))
    found = spans.select("key", "n", F.expr("base + i - 1").alias("start"), F.expr("substring(slice, i, n)").alias("piece")).join(
        F.broadcast(pieces.table(keyed.sparkSession)), "piece", "left"
    )
    return found.where("id is not null or n = 1").select(
        F.expr("if(start = 0 and n = 1, key, null)").alias("key"),
        "start",
        F.expr("start + n").alias("stop"),
        F.coalesce("id", F.lit(UNKNOWN)).alias("id"),
        F.coalesce("score", F.lit(pieces.unknown)).alias("score"),
        F.expr("if(id is null, piece, null)").alias("letter"),
    )


def solve(keyed: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, ids, unknown, whole) for distinct (key, word): the best pieces, how many of them stand for a byte, and
    whether decoding them gives the word again.

    The edges of a word follow one another by start, as they were exploded, so a task folds them as a stream, with neither
    a shuffle nor a sort: it holds a score and a way back per character of one word. When the first edge from a place comes,
    all edges to it were seen. Of equal ways the longest last piece wins.
    """
    octets, names = pieces.bytes, pieces.names
    spelled = [name.encode() for name in names]
    for b, i in enumerate(octets):
        spelled[i] = bytes([b])

    def result(key: str, found: list[int], froms: list[int], letters: dict[int, str]) -> tuple:
        path, at = [], len(froms) - 1
        while at:
            path.append(at)
            at = froms[at]
        ids, unknown = [], 0
        for at in reversed(path):
            if found[at] != UNKNOWN:
                ids.append(found[at])
            else:
                own = [octets[b] for b in letters[froms[at]].encode()]
                unknown += len(own)
                ids += own
        text = b"".join([spelled[i] for i in ids])
        whole = text == key.encode() if len(froms) <= SHORT + 1 else "#" + hashlib.sha256(text).hexdigest() == key
        return key, ids, unknown, whole

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, done = None, []
        for batch in batches:
            edges = [batch.column(c).to_numpy().tolist() for c in ("start", "stop", "id", "score")]
            opens, odd = (np.flatnonzero(batch.column(c).is_valid().to_numpy(zero_copy_only=False)).tolist() for c in ("key", "letter"))
            names, signs = (batch.column(c).drop_null().to_pylist() for c in ("key", "letter"))
            cuts, seen = [0, *opens, batch.num_rows], 0
            for part, (first, after) in enumerate(zip(cuts, cuts[1:])):  # part 0 goes on with the batch before
                if part:
                    if key is not None:
                        done.append(result(key, found, froms, letters))
                    key, scores, found, froms, letters, last = names[part - 1], [0.0], [0], [0], {}, 0
                for start, stop, piece, score in zip(*(c[first:after] for c in edges)):
                    if start < last or start >= len(scores):
                        raise ValueError("the edges of a word are out of order")
                    last, score = start, scores[start] + score
                    while stop >= len(scores):  # places that no edge has reached
                        scores.append(-inf)
                        found.append(0)
                        froms.append(0)
                    if score > scores[stop]:
                        scores[stop], found[stop], froms[stop] = score, piece, start
                while seen < len(odd) and odd[seen] < after:
                    letters[edges[0][odd[seen]]] = signs[seen]
                    seen += 1
            yield table(done)
            done = []
        if key is not None:
            yield table([result(key, found, froms, letters)])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.list_(pa.int32()), pa.int32(), pa.bool_())
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "ids", "unknown", "whole"])

    return _edges(keyed, pieces).mapInArrow(fold, "key string, ids array<int>, unknown int, whole boolean")


def decoded(ids: Column, pieces: Pieces) -> Column:
    """The UTF-8 bytes that ids stand for, marks still in place. Null ids give null."""
    byte = {i: b for b, i in enumerate(pieces.bytes)}
    spelled = [bytes([byte[i]]) if i in byte else name.encode() for i, name in enumerate(pieces.names)]
    table = F.split(F.lit(",".join(s.hex() for s in spelled)), ",")  # folded to a constant
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""))


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with a column ``text`` of the texts its ids stand for; the leading blank goes, marks become blanks."""
    whole = F.translate(decoded(F.col(ids), pieces).cast("string"), MARK, " ")
    return df.withColumn(text, F.regexp_replace(whole, "^ ", ""))


def occurrences(df: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, none, place, ids, unknown, whole): the pieces of each word at each place of each text.

    ``row`` numbers the input's rows by their place, so the input must read alike twice, as files do. A text without
    words has one row, with null place and ids; ``none`` tells null texts from empty ones.
    """
    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).isNull().alias("none"), words(F.col(text)).alias("words"))
    placed = texts.select("row", "doc_id", "none", F.posexplode_outer("words").alias("place", "word")).where("word is null or word != ''")
    thin = df.select(text).sample(THINNED, seed=17).select(F.explode(words(F.col(text))).alias("word"))
    short = (F.col("word") != "") & (F.length("word") <= SHORT)
    counts = checkpointed(thin.where(short).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"))
    steps = [F.sum((F.col("n") >= 1 << p).cast("long")).alias(str(p)) for p in range(1, 63)]
    sizes = counts.agg(*steps).first()
    least = 1 << next(p for p in range(1, 63) if (sizes[str(p)] or 0) <= BROADCAST_WORDS)
    hot = counts.where(F.col("n") >= least).select(F.col("word").alias("key"), "word")
    solved = checkpointed(solve(hot, pieces))  # BROADCAST_WORDS rows at most
    near = placed.join(F.broadcast(solved.withColumnRenamed("key", "word")), "word", "left")
    done = near.where("ids is not null or word is null").select("row", "doc_id", "none", "place", "ids", "unknown", "whole")
    # a short word is its key, so occurrences travel with one text
    spelled = F.when(F.length("word") > SHORT, F.col("word")).alias("long")
    rest = near.where("ids is null and word is not null").select("row", "doc_id", "place", _key(F.col("word")).alias("key"), spelled)
    rest = rest.where("key is not null").repartition("key")
    # Words and occurrences share this shuffle as long as both read all its columns, hence two checks that always hold.
    read = (F.max("row") >= 0) & (F.max("place") >= 0) & (F.count("doc_id") >= 0)
    kinds = rest.groupBy("key", "long").agg(read.alias("read")).where("read")
    others = solve(kinds.select("key", F.coalesce("long", "key").alias("word")), pieces)
    none = F.lit(False).alias("none")
    whole = (F.col("whole") & (F.coalesce(F.length("long"), F.lit(SHORT + 1)) > SHORT)).alias("whole")
    far = rest.join(others, "key").select("row", "doc_id", none, "place", "ids", "unknown", whole)
    return done.unionByName(far)


def encode(df: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the whole text's pieces, one row per row. A null text has null ids, an empty one none.

    Texts are taken as they are (no normalisation but blanks to marks); a literal mark in a text reads as a blank when
    decoded. Repeated rows and null ids are rows like any other, other columns are ignored, no rows give no rows. Time
    grows with a text's length also where the text is one word.
    """
    rows = occurrences(df, pieces, key, text)
    order = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "ids"))))
    ids = F.flatten(F.transform(order, lambda x: x["ids"]))
    return rows.groupBy("row", "doc_id", "none").agg(ids.alias("ids")).select(
        "doc_id", F.when(~F.col("none"), F.col("ids")).alias("ids")
    )


def totals(df: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_pieces, n_byte_pieces, digest, round_trip): the encoding of each text in numbers.

    ``digest`` is the exclusive or over words of the hash of place and ids, so it depends on each piece and its order,
    and partial results add up before the shuffle. ``round_trip``: each word decodes to itself.
    """
    rows = occurrences(df, pieces, key, text)
    some = F.col("place").isNotNull()
    return (
        rows.groupBy("row", "doc_id")
        .agg(
            F.count("place").alias("n_words"),
            F.coalesce(F.sum(F.when(some, F.size("ids"))), F.lit(0)).alias("n_pieces"),
            F.coalesce(F.sum("unknown"), F.lit(0)).alias("n_byte_pieces"),
            F.coalesce(F.bit_xor(F.when(some, F.xxhash64("place", "ids"))), F.lit(0)).alias("digest"),
            F.coalesce(F.bool_and("whole"), F.lit(True)).alias("round_trip"),
        )
        .drop("row")
    )
