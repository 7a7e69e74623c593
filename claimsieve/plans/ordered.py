"""Exact global ranks, running totals and quantiles without a single-task window.

Rows are first reduced to one row per distinct value, so a value held by a third
of the table costs one row. Approximate quantiles then cut the value axis into a
bounded number of ranges; ranks inside a range come from a window partitioned by
range, and the few range totals give each range its offset. The approximation
only decides where ranges start, never a result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import clean_number
from ..functions.text import quoted
from ..session import range_buckets


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


#: Value ranges counted per column to find a quantile.
QUANTILE_BUCKETS = 256


def bucketed_cells(df: DataFrame, columns: list[str], measures: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """``column, bucket, value`` and the measures, one row per cell with a number; nothing is shuffled."""
    dtypes = {f.name: f.dataType for f in df.schema}
    values = [clean_number(c, dtypes[c]).alias(f"v{i}") for i, c in enumerate(columns)]
    frame = df.select(*values, *[m.alias(name) for name, m in measures.items()])
    names = [f"v{i}" for i in range(len(columns))]

    count = buckets or range_buckets(df.sparkSession)
    cuts = frame.approxQuantile(names, [i / count for i in range(1, count)], 0.25 / count)
    splits = [[-float("inf"), *sorted(set(c)), float("inf")] for c in cuts]
    frame = Bucketizer(
        inputCols=names,
        outputCols=[f"b{i}" for i in range(len(columns))],
        splitsArray=[s if len(s) > 2 else [-float("inf"), 0.0, float("inf")] for s in splits],
        handleInvalid="keep",
    ).transform(frame)
    cells = ", ".join(
        f"named_struct('column', {quoted(c)}, 'bucket', CAST(b{i} AS INT), 'value', v{i})" for i, c in enumerate(columns)
    )
    return frame.selectExpr(f"inline(array({cells}))", *measures).where(F.col("value").isNotNull())


def value_distribution(
    df: DataFrame,
    columns: list[str],
    measures: dict[str, Column] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One row per (column, distinct value): ``column, bucket, value, n`` and the measure sums.

    ``measures`` are row expressions summed per value. Nulls, NaN and infinities
    are left out.
    """
    measures = measures or {}
    cells = bucketed_cells(df, columns, measures, buckets)
    return cells.groupBy("column", "bucket", "value").agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in measures])


def with_running_totals(dist: DataFrame, totals: list[str] = ["n"], descending: bool = False) -> DataFrame:
    """Add ``<t>_before``, ``<t>_upto`` and ``<t>_total`` per column in value order for each total."""
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    # At most range_buckets() rows per column from here to the broadcast.
    ranges = dist.groupBy("column", "bucket").agg(*[F.sum(t).alias(f"_{t}") for t in totals])
    across = Window.partitionBy("column").orderBy(order("bucket"))
    offsets = ranges.select(
        "column",
        "bucket",
        *[
            F.coalesce(F.sum(f"_{t}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{t}_off")
            for t in totals
        ],
        *[F.sum(f"_{t}").over(Window.partitionBy("column")).alias(f"{t}_total") for t in totals],
    )
    within = Window.partitionBy("column", "bucket").orderBy(order("value")).rowsBetween(Window.unboundedPreceding, 0)
    joined = dist.join(F.broadcast(offsets), ["column", "bucket"])
    upto = {f"{t}_upto": F.col(f"_{t}_off") + F.sum(t).over(within) for t in totals}
    ranked = joined.withColumns(upto)
    before = {f"{t}_before": F.col(f"{t}_upto") - F.col(t) for t in totals}
    return ranked.withColumns(before).drop(*[f"_{t}_off" for t in totals])


def quantiles_of(ranked: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per column of a ranked distribution: ``column, n, <names>``."""
    picks = []
    for name, p in probabilities.items():
        position = (F.col("n_total") - 1) * F.lit(p)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (F.col("n_before") <= rank) & (rank < F.col("n_upto"))
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"_{name}_{side}"))
    found = ranked.groupBy("column").agg(F.max("n_total").alias("n"), *picks)
    result = []
    for name, p in probabilities.items():
        position = (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        result.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select("column", "n", *result)


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per column: ``column, n, <names>``.

    Rows are counted per value range first, at most QUANTILE_BUCKETS numbers per column and task. Only
    the ranges that hold a wanted rank have their values shuffled and ranked.
    """
    cells = bucketed_cells(df, columns, {}, QUANTILE_BUCKETS)
    per_column = Window.partitionBy("column")
    sizes = cells.groupBy("column", "bucket").agg(F.count("*").alias("_n")).select(
        "column", "bucket", "_n",
        F.coalesce(F.sum("_n").over(per_column.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(per_column).alias("n_total"),
    )
    wanted = F.lit(False)
    for p in probabilities.values():
        position = (F.col("n_total") - 1) * F.lit(p)
        for rank in (F.floor(position), F.ceil(position)):
            wanted = wanted | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")))
    needed = sizes.where(wanted).select("column", "bucket", "_before", "n_total")
    # At most two ranges per quantile and column.
    inside = cells.join(F.broadcast(needed), ["column", "bucket"])
    inside = inside.groupBy("column", "bucket", "value", "_before", "n_total").agg(F.count("*").alias("n"))
    within = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("n_upto", F.col("_before") + F.sum("n").over(within)).withColumn("n_before", F.col("n_upto") - F.col("n"))
    return quantiles_of(ranked, probabilities)


def approximate_quantiles(df: DataFrame, columns: list[str], probabilities: dict[str, float], error: float = 1e-3) -> DataFrame:
    """Sketch-based quantiles, one narrow pass; for data where an exact ranking is not worth a shuffle."""
    names = list(probabilities)
    found = df.approxQuantile(columns, [probabilities[p] for p in names], error)
    rows = [(c, *(values or [None] * len(names))) for c, values in zip(columns, found)]
    schema = "column string, " + ", ".join(f"`{p}` double" for p in names)
    return df.sparkSession.createDataFrame(rows, schema)
