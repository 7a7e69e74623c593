"""Isotonic fit from mergeable pools.

Points are dealt to ranges of the score. Each range pools its points that stand in the wrong order (pool adjacent violators),
which leaves a stack of blocks with rising means. Stacks of neighbouring ranges merge in a tree: blocks of both sides are pooled again
where they meet. Pooling in parts and then across parts gives the same blocks as pooling all points at once. What reaches the driver is the last
stack, of at most MOST_BLOCKS blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of the map at most; beyond it neighbouring blocks of least weight are merged.
MOST_BLOCKS = 65_536
#: Stacks merged by one task.
FAN_IN = 8

BLOCKS = "part long, low double, high double, mean double, weight double"


class Stack:
    """Blocks with rising means: (low score, high score, mean, weight)."""

    def __init__(self) -> None:
        self.blocks: list[tuple[float, float, float, float]] = []

    def push(self, low: float, high: float, mean: float, weight: float) -> None:
        """Add what lies above all blocks so far."""
        while self.blocks and self.blocks[-1][2] >= mean:
            first, _, other, more = self.blocks.pop()
            low, mean, weight = first, (other * more + mean * weight) / (more + weight), more + weight
        self.blocks.append((low, high, mean, weight))

    def frame(self, part: int) -> pd.DataFrame:
        out = pd.DataFrame(self.blocks, columns=["low", "high", "mean", "weight"], dtype=float)
        out.insert(0, "part", part)
        return out


def bounded(blocks: pd.DataFrame, most: int) -> pd.DataFrame:
    """At most ``most`` blocks, by merging neighbours into shares of about equal weight; means still rise."""
    if len(blocks) <= most:
        return blocks
    share = np.minimum((blocks["weight"].cumsum() - blocks["weight"] / 2) / blocks["weight"].sum() * most, most - 1).astype(int)
    sums = blocks.assign(total=blocks["mean"] * blocks["weight"]).groupby(share).agg(part=("part", "first"), low=("low", "first"), high=("high", "last"), total=("total", "sum"), weight=("weight", "sum"))
    return sums.assign(mean=sums["total"] / sums["weight"])[["part", "low", "high", "mean", "weight"]]


def pooled_blocks(points: DataFrame, parts: int | None = None, most: int = MOST_BLOCKS) -> DataFrame:
    """(part, low, high, mean, weight): the pooled blocks of (score, label, weight) points with distinct scores."""
    parts = parts or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack = Stack()
        for batch in batches:
            for score, label, weight in zip(batch["score"].tolist(), batch["label"].tolist(), batch["weight"].tolist()):
                stack.push(score, score, label, weight)
        yield stack.frame(TaskContext.get().partitionId())

    def merge(stacks: pd.DataFrame) -> pd.DataFrame:
        stack = Stack()
        for row in stacks.sort_values("low").itertuples(index=False):
            stack.push(row.low, row.high, row.mean, row.weight)
        return bounded(stack.frame(int(stacks["part"].iloc[0]) // FAN_IN), most)

    blocks = points.repartitionByRange(parts, "score").sortWithinPartitions("score").mapInPandas(pool, BLOCKS)
    while parts > 1:
        blocks = blocks.groupBy(F.floor(F.col("part") / FAN_IN).alias("_group")).applyInPandas(merge, BLOCKS)
        parts = -(-parts // FAN_IN)
    return blocks


def fit_isotonic(scored: DataFrame, score: str = "_score", parts: int | None = None, most: int = MOST_BLOCKS) -> IsotonicRegressionModel:
    """Isotonic map from score to label; equal scores are merged into one weighted point first.

    Spark's own fit then only sees the ends of the blocks, which are in order already.
    """
    points = scored.groupBy(F.col(score).alias("score")).agg(F.avg(F.col("label").cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    blocks = pooled_blocks(points.where("score IS NOT NULL"), parts, most).collect()
    # A block of one score is one point, any other one its two ends.
    ends = [(x, b["mean"], b["weight"] / (1 if b["low"] == b["high"] else 2)) for b in blocks for x in sorted({b["low"], b["high"]})]
    frame = scored.sparkSession.createDataFrame(ends, f"`{score}` double, label double, weight double").coalesce(1)
    return IsotonicRegression(featuresCol=score, labelCol="label", weightCol="weight", predictionCol="_cal").fit(frame)
