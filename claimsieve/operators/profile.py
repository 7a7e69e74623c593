"""Upload profile and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import clean_number
from ..functions.text import quoted
from ..plans.ordered import approximate_quantiles, exact_quantiles, numeric_columns
from ..session import stored


def _missing_counts(df: DataFrame) -> DataFrame:
    """One row: ``n`` and the missing cells per column, in a single scan."""
    counts = []
    for i, f in enumerate(df.schema):
        absent = f"`{f.name}` IS NULL"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            absent += f" OR isnan(`{f.name}`)"
        counts.append(F.expr(f"count_if({absent}) AS m{i}"))
    return df.agg(F.count("*").alias("n"), *counts)


def missing_pct(df: DataFrame) -> DataFrame:
    """``column, missing_pct``."""
    cells = ", ".join(
        f"named_struct('column', {quoted(c)}, 'missing_pct', try_divide(m{i}, n) * 100)" for i, c in enumerate(df.columns)
    )
    return _missing_counts(df).selectExpr(f"inline(array({cells}))")


def profile_upload(df: DataFrame) -> DataFrame:
    """One row: rows, columns by kind, share of missing and of present cells."""
    total = F.expr(" + ".join(f"m{i}" for i in range(len(df.columns))))
    missing = F.coalesce(F.try_divide(total, F.col("n") * len(df.columns)) * 100, F.lit(0.0))
    return _missing_counts(df).select(
        F.col("n").alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(sum(isinstance(f.dataType, T.StringType) for f in df.schema)).cast("bigint").alias("text_columns"),
        missing.alias("missing_pct"),
        (F.lit(100.0) - missing).alias("complete_pct"),
    )


def outlier_pct(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """``column, outlier_pct``: rows outside 1.5 interquartile ranges, nulls count as rows.

    With the quartiles known, one scan counts the rows outside; no value is shuffled for
    that. The numeric columns are stored once, so what makes the frame runs once. ``approx`` takes sketched quartiles.
    """
    columns = columns or numeric_columns(df)
    df = stored(df.select(*[F.col(f"`{c}`") for c in columns]), "profile") if columns else df
    shares = {"q1": 0.25, "q3": 0.75}
    quartiles = approximate_quantiles(df, columns, shares) if approx else exact_quantiles(df, columns, shares)
    bound = F.struct(
        (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high")
    )
    # One entry per column of the table.
    bounds = quartiles.agg(F.map_from_entries(F.collect_list(F.struct("column", bound))).alias("b")).scalar()
    dtypes = {f.name: f.dataType for f in df.schema}
    values = df.select(*[clean_number(c, dtypes[c]).alias(f"v{i}") for i, c in enumerate(columns)]).withColumn("_b", bounds)
    outside = [
        F.count_if((F.col(f"v{i}") < F.col("_b")[c]["low"]) | (F.col(f"v{i}") > F.col("_b")[c]["high"])).alias(f"o{i}") for i, c in enumerate(columns)
    ]
    present = [F.count(f"v{i}").alias(f"p{i}") for i in range(len(columns))]
    counts = values.agg(F.count("*").alias("n"), *outside, *present)
    # A column without numbers has no row.
    rows = ", ".join(f"named_struct('column', {quoted(c)}, 'outlier_pct', IF(p{i} > 0, o{i} / n * 100, NULL))" for i, c in enumerate(columns))
    return counts.selectExpr(f"inline(array({rows}))").where("outlier_pct IS NOT NULL") if columns else counts.selectExpr("'' AS column", "0D AS outlier_pct").limit(0)


def data_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, data_type string")


def quality_score(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row: ``100 − mean missing − half the mean outliers``, at least 0; null for an empty frame."""
    outliers = outlier_pct(df, approx=approx).agg(F.coalesce(F.avg("outlier_pct"), F.lit(0.0)).alias("o")).scalar()
    return (
        missing_pct(df)
        .agg(F.avg("missing_pct").alias("avg_missing_pct"))
        .withColumn("avg_outlier_pct", outliers)
        .withColumn(
            "quality_score",
            F.when(
                F.col("avg_missing_pct").isNotNull(),
                F.greatest(F.lit(0.0), F.lit(100.0) - F.col("avg_missing_pct") - F.col("avg_outlier_pct") * 0.5),
            ),
        )
    )


def data_quality(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: missing share, outlier share (numeric columns) and data type."""
    return (
        missing_pct(df)
        .join(F.broadcast(outlier_pct(df, approx=approx)), "column", "left")
        .join(F.broadcast(data_types(df)), "column", "left")
    )
