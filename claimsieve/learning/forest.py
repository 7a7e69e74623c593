"""Probabilities of a fitted random forest, a batch of rows at a time.

Spark's model takes a row through one tree after the other, so most nodes come from memory anew for every row. Here a block of rows goes
through one tree, all of them a level further in each step, while the tree stays in the cache. The trees are read from what
the fitted model saves. Each leaf has the shares that the model would add, and they are added in its order.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows that go through a tree together.
BLOCK_ROWS = 5_000

#: One tree: per node the feature asked, the threshold, the node for larger values (the next one is for the others) and
#: the shares of both classes; then its depth. A leaf leads to itself: nothing is below its threshold, which is no number.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]

_TREES: WeakKeyDictionary = WeakKeyDictionary()

NODES = [
    "treeID AS tree",
    "nodeData.id AS node",
    "nodeData.leftChild AS left",
    "nodeData.rightChild AS right",
    "nodeData.split.featureIndex AS feature",
    "get(nodeData.split.leftCategoriesOrThreshold, 0) AS threshold",
    "get(nodeData.impurityStats, 0) AS negative",
    "get(nodeData.impurityStats, 1) AS positive",
]


def _tree(left: np.ndarray, right: np.ndarray, feature: np.ndarray, threshold: np.ndarray, negative: np.ndarray, positive: np.ndarray) -> Tree:
    """A tree whose nodes are in the order of their ids, renumbered so that siblings stand side by side, the right one first."""
    inner = np.flatnonzero(left >= 0)
    place = np.zeros(len(left), np.intp)
    place[right[inner]] = 1 + 2 * np.arange(len(inner))
    place[left[inner]] = 2 + 2 * np.arange(len(inner))
    below = np.arange(len(left))
    below[place[inner]] = place[right[inner]]
    asked, limit = np.zeros(len(left), np.intp), np.full(len(left), np.nan)
    asked[place[inner]], limit[place[inner]] = feature[inner], threshold[inner]
    total = negative + positive
    shares = np.zeros((2, len(left)))
    shares[:, place] = np.divide((negative, positive), total, out=np.zeros((2, len(left))), where=total != 0)
    depth, level = 0, np.zeros(1, np.intp)
    while len(level := level[left[level] >= 0]):
        depth, level = depth + 1, np.concatenate([left[level], right[level]])
    return asked, limit, below, shares[0], shares[1], depth


def forest_trees(model: RandomForestClassificationModel, spark: SparkSession) -> list[Tree]:
    """The trees of a model of two classes over numbers, read once per model."""
    if model not in _TREES:
        path = scratch_path(spark, "forest")
        model.write().save(path)
        saved = spark.read.parquet(f"{path}/data").selectExpr(*NODES).toArrow()
        saved = saved.sort_by([("tree", "ascending"), ("node", "ascending")])
        tree, _, *columns = (c.to_numpy() for c in saved.columns)
        ends = np.flatnonzero(np.diff(tree)) + 1
        _TREES[model] = [_tree(*parts) for parts in zip(*(np.split(c, ends) for c in columns))]
    return _TREES[model]


def positive_share(trees: list[Tree], rows: np.ndarray) -> np.ndarray:
    """Probability of the second class for each of (rows, features)."""
    values, width = np.ascontiguousarray(rows).ravel(), rows.shape[1]
    found = np.empty(len(rows))
    for begin in range(0, len(rows), BLOCK_ROWS):
        first = np.arange(begin, min(begin + BLOCK_ROWS, len(rows))) * width
        negative, positive = np.zeros(len(first)), np.zeros(len(first))
        for asked, limit, below, no, yes, depth in trees:
            at = np.zeros(len(first), np.intp)
            for _ in range(depth):
                at = below.take(at) + (values.take(first + asked.take(at)) <= limit.take(at))
            negative += no.take(at)
            positive += yes.take(at)
        total = negative + positive
        found[begin : begin + len(first)] = np.divide(positive, total, out=positive, where=total != 0)
    return found


def forest_probability(model: RandomForestClassificationModel, features: Column, spark: SparkSession) -> Column:
    """Probability of the second class for an array of features."""
    shared, width = spark.sparkContext.broadcast(forest_trees(model, spark)), model.numFeatures

    @F.arrow_udf("double")
    def probability(arrays: pa.Array) -> pa.Array:
        return pa.array(positive_share(shared.value, arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), width)))

    return probability(features)
