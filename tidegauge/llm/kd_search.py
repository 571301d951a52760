"""Exact top-k by inner product with one KD-tree per shard.

Vectors become whole numbers, floor(1024 x), so scores are exact and equal in every engine. A tree splits at the
median of its widest dimension and keeps tight boxes. The largest inner product that a box allows is the sum over
dimensions of the larger of q * low and q * high; a search takes nodes in the order of that bound and stops at the
first below the kth score. Each query first searches the shard it lives in; the kth score found there goes with it to
all other shards, so that most of their branches end at once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SCALE = 1024
SHARD_ROWS = 8192
QUERY_BLOCK = 4096
LEAF = 256


class Tree:
    """Median splits over the vectors of a shard; of equal vectors the rows with the least ids stay, at most ``keep`` of
    an id and no more than give any query ``keep`` rows of other ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, keep: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)[group]
        place = np.arange(len(ids)) - start
        named = new.copy()
        named[1:] |= ids[1:] != ids[:-1]
        first = np.flatnonzero(named)[np.cumsum(named) - 1]
        # A query leaves out one id at most. Of the rows before a row, those of the id with the most among them may be
        # left out, so a row goes only if ``keep`` rows of other ids remain before it.
        size = np.diff(np.append(np.flatnonzero(named), len(ids)))
        most = np.zeros(len(ids), np.int64)  # the most rows of one id before this id, within the group
        runs, whose, best = np.flatnonzero(named), group[named], 0
        for n, at in enumerate(runs.tolist()):
            best = 0 if not n or whose[n] != whose[n - 1] else max(best, int(size[n - 1]))
            most[at : at + size[n]] = best
        kept = (np.arange(len(ids)) - first < keep) & (first - start - most < keep)
        self.vectors, self.ids = vectors[kept].astype(np.float64), ids[kept]
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.rows: list[np.ndarray | None] = []
        self.children: list[tuple[int, int] | None] = []
        self._grow(np.arange(len(self.ids)))

    def _grow(self, rows: np.ndarray) -> None:
        stack = [(rows, -1)]
        while stack:
            rows, parent = stack.pop()
            node, points = len(self.rows), self.vectors[rows]
            self.low.append(points.min(axis=0))
            self.high.append(points.max(axis=0))
            self.rows.append(None)
            self.children.append(None)
            if parent >= 0:
                a, b = self.children[parent]
                self.children[parent] = (a, node) if a >= 0 else (node, b)
            width = self.high[node] - self.low[node]
            axis = int(np.argmax(width))
            if len(rows) <= LEAF or width[axis] == 0:
                self.rows[node] = rows
                continue
            middle = len(rows) // 2
            by = np.argpartition(points[:, axis], middle)
            self.children[node] = (-1, -1)
            stack.append((rows[by[:middle]], node))
            stack.append((rows[by[middle:]], node))

    def search(self, query: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, id) of this shard among those with score ``least`` or more; ties go to smaller ids."""
        if not len(self.ids):
            return []
        positive, negative = np.maximum(query, 0), np.minimum(query, 0)
        bound = lambda n: float(self.high[n] @ positive + self.low[n] @ negative)
        queue, best = [(-bound(0), 0)], []  # best: heap of (score, -id), the worst on top
        while queue:
            above, node = heapq.heappop(queue)
            limit = best[0][0] if len(best) == k else least
            if -above < max(limit, least):  # a box at the very limit may hold a tie with a smaller id
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if (b := bound(child)) >= limit:
                        heapq.heappush(queue, (-b, child))
                continue
            rows = self.rows[node]
            scores = self.vectors[rows] @ query
            chosen = np.flatnonzero((scores >= max(limit, least)) & (self.ids[rows] != own))
            if len(chosen) > k:
                chosen = chosen[np.lexsort((self.ids[rows[chosen]], -scores[chosen]))[:k]]
            for score, name in zip(scores[chosen].tolist(), self.ids[rows[chosen]].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (score, -name))
                elif (score, -name) > best[0]:
                    heapq.heapreplace(best, (score, -name))
        return [(int(score), -name) for score, name in best]


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): components as floor(1024 x). Rows with a null id or vector, or a null or non-finite component, go."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v")
    )


def top_k(
    df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products of each query with all other rows.

    Ties go to the smaller vec_id; a query with fewer candidates has fewer ranks, and vectors of another length than
    the query's are no candidates. Rows that share a vec_id share it as candidates too: each is scored, and a query
    leaves out all rows with its own id. Queries meet all shards in blocks, which is the whole of the work asked for;
    a shard's answer is at most ``k`` rows per query. Scores are exact while |score| < 2^53. Other columns are ignored.
    """
    sized = lambda d: d.withColumn("dim", F.size("v"))
    rows = checkpointed(sized(whole_vectors(df, key, vector)))
    asked = checkpointed(sized(whole_vectors(queries, key, vector)))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    shape = "query_id long, vec_id long, score long"

    def search(points: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(points) and len(wanted):
            # A leading 0 gives vectors without components a dimension and changes no score.
            pad = lambda v: np.concatenate(([0], np.asarray(v, np.int64)))
            tree = Tree(np.stack([pad(v) for v in points["v"]]), points["vec_id"].to_numpy(np.int64), k)
            for name, query, least in zip(wanted["vec_id"].tolist(), wanted["v"], wanted["least"].tolist()):
                least = -np.inf if least is None or np.isnan(least) else least
                for score, other in tree.search(pad(query).astype(np.float64), name, k, least):
                    found["query_id"].append(name)
                    found["vec_id"].append(other)
                    found["score"].append(score)
        return pd.DataFrame(found).astype("int64")

    def meet(points: DataFrame, wanted: DataFrame) -> DataFrame:
        on = ["dim", "shard", "block"]
        return points.groupBy(*on).cogroup(wanted.groupBy(*on)).applyInPandas(search, shape)

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    points = rows.select("dim", "vec_id", "v", home("vec_id").cast("int").alias("shard"), every(blocks, "block"))
    wanted = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int"))
    at_home = wanted.withColumn("shard", home("vec_id").cast("int")).withColumn("least", F.lit(None).cast("double"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = meet(points, at_home).withColumn("rank", F.row_number().over(rank))
    known = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    known = checkpointed(known)
    everywhere = wanted.join(known.withColumn("least", F.col("least").cast("double")), "vec_id", "left")
    answers = meet(points, everywhere.select("*", every(shards, "shard")))
    return answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
