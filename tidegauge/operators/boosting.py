"""Boosted regression trees with a penalty on leaf values.

Spark's own boosting takes the mean of a leaf's residuals. Here each tree is grown by Spark on the residuals of the
trees before it, its leaves are named by ``leafCol``, and their values are taken anew from the rows as the sum of the
residuals over (rows + penalty). The penalty bears on leaf values, not on the choice of splits.

Rows with equal features fall into the same leaf of every tree. Where they are many, they become one row with their mean
label, weighted with their number: splits differ in gain by the same amount for all, and sums by leaf stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import checkpointed

MAX_BINS = 256
LINEAGE = 10  # trees after which the residuals are written to the checkpoint folder
MERGED = 2  # rows per different features from which rows are merged
ROWS_PER_TASK = 50_000  # merged rows of a task
CELLS = 1_000_000  # numbers that a task holds while it scores
LEAF, OWN, MARGIN, RESIDUAL, WEIGHT = "_leaf", "_own", "_margin", "_residual", "_rows"
# a line of a tree's text that opens a node: a split's feature with its threshold or its left categories, or a leaf
NODE = re.compile(r"\s*(?:If \(feature (?P<feature>\d+) (?:<= (?P<most>\S+)|in \{(?P<set>[^}]*)\})\)|Predict: )")


@dataclass
class Tree:
    """A grown tree and the values of its leaves, in the tree's order of leaves."""

    model: DecisionTreeRegressionModel
    values: list[float]

    def steps(self, rate: float) -> Steps:
        """The tree as arrays. Its text names the nodes from the top, left before right, as leaves are numbered."""
        feature, threshold, value, children = [], [], [], []
        lefts: dict[int, list[float]] = {}
        waiting: list[int] = []  # splits that lack a child
        leaves = iter(self.values)
        for found in filter(None, map(NODE.match, self.model.toDebugString.splitlines())):
            at, is_leaf = len(feature), found["feature"] is None
            if waiting:
                children[waiting[-1]].append(at)
                if len(children[waiting[-1]]) == 2:
                    waiting.pop()
            feature.append(int(found["feature"] or 0))
            threshold.append(float(found["most"] or "inf"))
            # leaves after the last that any row reached have no value
            value.append(rate * next(leaves, 0.0) if is_leaf else 0.0)
            children.append([at, at] if is_leaf else [])
            if found["set"] is not None:
                lefts[at] = [float(c) for c in found["set"].split(",") if c]
            if not is_leaf:
                waiting.append(at)
        return Steps(
            self.model.depth, np.repeat(feature, 2), np.repeat(threshold, 2), 2 * np.array(children).ravel(), lefts, np.repeat(value, 2)
        )


@dataclass
class Steps:
    """A tree's nodes, each in two places: the even one is the node, and its ``following`` are those of its left and right
    child. A leaf follows itself. ``lefts`` holds the categories that go left, where a node splits by categories."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    following: np.ndarray
    lefts: dict[int, list[float]]
    value: np.ndarray

    def added(self, features: np.ndarray) -> np.ndarray:
        """The tree's step for each column of ``features``."""
        n = features.shape[1]
        flat, row = features.ravel(), np.arange(n)
        start = self.feature * n
        at = np.zeros(n, dtype=np.int64)
        for _ in range(self.depth):
            x = flat[start[at] + row]
            is_right = ~(x <= self.threshold[at])
            for node, categories in self.lefts.items():
                here = at == 2 * node
                is_right[here] = ~np.isin(x[here], categories)
            at = self.following[at + is_right]
        return self.value[at]


def _gathered(batches: Iterator[pa.Array]) -> Iterator[np.ndarray]:
    """The vectors of several batches as rows of one matrix of about CELLS numbers."""
    held: list[pa.Array] = []
    cells = 0
    for vectors in batches:
        if len(vectors):
            held.append(vectors)
            cells += len(vectors.flatten())
        if cells >= CELLS:
            yield _matrix(held)
            held, cells = [], 0
    if held:
        yield _matrix(held)


def _matrix(held: list[pa.Array]) -> np.ndarray:
    numbers = np.concatenate([v.flatten().to_numpy(zero_copy_only=False) for v in held])
    return numbers.reshape(sum(map(len, held)), -1)


def _predictions(rows: np.ndarray, base: float, steps: list[Steps]) -> np.ndarray:
    """Rows of equal features are walked through the trees once."""
    n, width = rows.shape
    bits = pa.Array.from_buffers(pa.binary(8 * width), n, [None, pa.py_buffer(np.ascontiguousarray(rows))]).dictionary_encode()
    _, found = bits.dictionary.buffers()
    kinds = np.frombuffer(found, dtype=np.float64, count=len(bits.dictionary) * width).reshape(-1, width)
    features = np.ascontiguousarray(kinds.T)
    out = np.full(len(kinds), base)
    for tree in steps:
        out += tree.added(features)
    return out[bits.indices.to_numpy()]


class PenalisedBoostingModel(Model, HasFeaturesCol, HasPredictionCol):
    """The mean of the labels and the trees' steps. A row passes all trees at once, by the arrays of their nodes, so the plan
    has one step however many trees there are."""

    def __init__(self, base: float, trees: list[Tree], rate: float, features: str, prediction: str) -> None:
        super().__init__()
        self.base, self.trees, self.rate = base, trees, rate
        self._set(featuresCol=features, predictionCol=prediction)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base, steps = self.base, [tree.steps(self.rate) for tree in self.trees]

        @F.arrow_udf("double")
        def summed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows in _gathered(batches):
                yield pa.array(_predictions(rows, base, steps))

        return dataset.withColumn(self.getPredictionCol(), summed(vector_to_array(self.getFeaturesCol())))


class PenalisedBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Least-squares boosting; rows without a label take no part.

    One aggregate counts the rows and, nearly, the different features, and so decides whether rows are merged. Every tree
    takes Spark's jobs for one tree and one sum by leaf; only leaf values come to the driver, at most one
    per ``min_rows`` rows and 2^depth. Residuals stay in executors' storage and are checkpointed every LINEAGE trees,
    so that a lost executor costs at most that many steps.
    """

    def __init__(self, trees: int, rate: float, depth: int, min_rows: int, penalty: float, seed: int) -> None:
        super().__init__()
        if penalty < 0:
            raise ValueError(f"the penalty must not be negative, got {penalty}")
        self.trees, self.rate, self.depth, self.min_rows, self.penalty, self.seed = trees, rate, depth, min_rows, penalty, seed

    def setFeaturesCol(self, value: str) -> PenalisedBoosting:
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str) -> PenalisedBoosting:
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str) -> PenalisedBoosting:
        return self._set(predictionCol=value)

    def _fit(self, dataset: DataFrame) -> PenalisedBoostingModel:
        label = F.col(self.getLabelCol()).cast("double")
        rows = dataset.where(label.isNotNull()).select(self.getFeaturesCol(), label.alias("_label"))
        base, total, kinds = rows.agg(F.avg("_label"), F.count("*"), F.approx_count_distinct(self.getFeaturesCol())).first()
        if base is None:
            raise ValueError("no row has a label")
        if total >= MERGED * kinds:
            rows = rows.groupBy(self.getFeaturesCol()).agg(F.avg("_label").alias("_label"), F.count("*").cast("double").alias(WEIGHT))
            rows = rows.repartition(max(1, -(-kinds // ROWS_PER_TASK)))
        else:
            rows = rows.withColumn(WEIGHT, F.lit(1.0))
        can_split = 2 * self.min_rows <= total
        grower = DecisionTreeRegressor(
            featuresCol=self.getFeaturesCol(), labelCol=RESIDUAL, predictionCol=OWN, leafCol=LEAF, weightCol=WEIGHT,
            maxDepth=self.depth if can_split else 0, maxBins=MAX_BINS, minInstancesPerNode=1, seed=self.seed,
            # the least number of rows as a share of the weights, half a row lower against rounding
            minWeightFractionPerNode=max(0.0, (self.min_rows - 0.5) / total) if can_split else 0.0,
        )
        held = rows.persist()
        current = held.withColumn(MARGIN, F.lit(base))
        grown: list[Tree] = []
        for number in range(1, self.trees + 1):
            left = current.withColumn(RESIDUAL, F.col("_label") - F.col(MARGIN))
            model = grower.fit(left)
            leaves = model.transform(left).drop(RESIDUAL, OWN)
            leaves = (checkpointed(leaves) if number % LINEAGE == 0 else leaves).persist()
            own = F.sum((F.col("_label") - F.col(MARGIN)) * F.col(WEIGHT)) / (F.sum(WEIGHT) + F.lit(float(self.penalty)))
            found = {int(r[LEAF]): r["v"] for r in leaves.groupBy(LEAF).agg(own.alias("v")).collect()}
            grown.append(Tree(model, [found.get(i, 0.0) for i in range(max(found) + 1)]))
            held.unpersist()
            held = leaves
            step = F.get(F.lit(grown[-1].values).cast("array<double>"), F.col(LEAF).cast("int")) * F.lit(self.rate)
            current = leaves.withColumn(MARGIN, F.col(MARGIN) + step).drop(LEAF)
        held.unpersist()
        return PenalisedBoostingModel(base, grown, self.rate, self.getFeaturesCol(), self.getPredictionCol())
