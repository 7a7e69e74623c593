"""Evaluation of binary scores as single aggregates over the score distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import value_distribution, with_running_totals

THRESHOLD = 0.5


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _counts(score: str, label: str, threshold: float) -> dict[str, Column]:
    positive, actual = F.col(score) > threshold, F.col(label) == 1
    return {
        "tp": F.count_if(positive & actual),
        "fp": F.count_if(positive & ~actual),
        "fn": F.count_if(~positive & actual),
        "tn": F.count_if(~positive & ~actual),
    }


def classification_metrics(df: DataFrame, score: str = "probability", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row of metrics in one pass; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    counts = df.agg(*[c.alias(n) for n, c in _counts(score, label, threshold).items()])
    return counts.select(
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + tn + fp + fn).alias("n_samples"),
        (tp + fn).alias("n_fraud"),
        (tn + fp).alias("n_legitimate"),
    )


def f1_scores(df: DataFrame, scores: list[str], label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row: F1 of each score column."""
    found = []
    for s in scores:
        c = _counts(s, label, threshold)
        found.append(_ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]).alias(f"{s}_f1"))
    return df.agg(*found)


def _score_totals(df: DataFrame, score: str, label: str, descending: bool) -> DataFrame:
    dist = value_distribution(df, [score], {"pos": (F.col(label) == 1).cast("bigint")})
    return with_running_totals(dist, ["n", "pos"], descending)


def roc_auc(df: DataFrame, score: str = "probability", label: str = "label") -> DataFrame:
    """One row ``roc_auc``: rank statistic with averaged ties; 0.5 when a class is missing."""
    ranked = _score_totals(df, score, label, descending=False)
    rank = (F.col("n_before") + 1 + F.col("n_upto")) / 2.0
    sums = ranked.agg(
        F.sum(rank * F.col("pos")).alias("r"), F.max("pos_total").cast("double").alias("p"), F.max("n_total").cast("double").alias("n")
    )
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(F.coalesce(F.try_divide(F.col("r") - p * (p + 1) / 2, p * q), F.lit(0.5)).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "probability", label: str = "label") -> DataFrame:
    """One row ``average_precision``: Σ (Rₙ − Rₙ₋₁)·Pₙ over distinct scores; 0.5 when a class is missing."""
    ranked = _score_totals(df, score, label, descending=True)
    step = F.col("pos") * F.col("pos_upto") / F.col("n_upto")
    sums = ranked.agg(F.sum(step).alias("s"), F.max("pos_total").alias("p"), F.max("n_total").alias("n"))
    one_class = (F.col("p") == 0) | (F.col("p") == F.col("n")) | F.col("n").isNull()
    return sums.select(F.when(one_class, 0.5).otherwise(F.try_divide(F.col("s"), F.col("p"))).alias("average_precision"))
