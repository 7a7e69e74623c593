"""Normality tests, Q-Q points and outlier bounds, all as distributed plans.

Ranks come from the value distribution (one row per distinct value), so ties and
hot values cost nothing extra and no column is sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clean_number, flag
from ..functions.normal import normal_cdf, polynomial, with_normal_ppf
from ..functions.text import double, with_expressions
from ..plans.ordered import exact_quantiles, value_distribution, with_running_totals

ALPHA = 0.05
TINY_DEVIATION = 1e-10
#: Ranks expanded into one row at a time; bounds the work of a row whatever the ties.
RANK_CHUNK = 65536

# --- fixed values: Royston (1995), algorithm AS R94, constant term first -----
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_GAMMA = [-2.273, 0.459]
SMALL_MU = [0.5440, -0.39978, 0.025054, -6.714e-4]
SMALL_SIGMA = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MU = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_SIGMA = [-0.4803, -0.082676, 0.0030302]


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, mean, std`` over finite values (sample deviation), in one scan."""
    types = {f.name: f.dataType for f in df.schema}
    aggregates = []
    for i, c in enumerate(columns):
        v = clean_number(c, types[c])
        aggregates += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows))


def _ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    return with_running_totals(value_distribution(df, columns))


def _rank_chunks(ranked: DataFrame) -> DataFrame:
    """Rank intervals ``_from .. _to`` of bounded length per value.

    A value with few ties is one interval where it stands. A hot value is cut into
    many, which a shuffle spreads over the tasks before anyone expands them.
    """
    first = F.col("n_before") + 1
    few = ranked.where(F.col("n") <= RANK_CHUNK).withColumns({"_from": first, "_to": F.col("n_upto")})
    starts = F.sequence(first, F.col("n_upto"), F.lit(RANK_CHUNK).cast("bigint"))
    many = (
        ranked.where(F.col("n") > RANK_CHUNK)
        .withColumn("_from", F.explode(starts))
        .withColumn("_to", F.least(F.col("_from") + RANK_CHUNK - 1, F.col("n_upto")))
        .repartition("column", "_from")
    )
    return few.unionByName(many)


def shapiro_wilk(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, shapiro_stat, shapiro_pvalue`` after Royston; null below 3 values or without spread.

    W uses every value. The p-value approximation is calibrated up to 5,000 values;
    beyond that it is reported as the formula gives it.
    """
    return _shapiro(_ranked(df, columns), moments(df, columns))


def _shapiro(ranked: DataFrame, stats: DataFrame) -> DataFrame:
    def share(rank: str) -> str:
        return f"(CAST({rank} AS DOUBLE) - 0.375D) / (CAST(n_total AS DOUBLE) + 0.25D)"

    # Interior order statistics share one scale, so their sums are enough; the two
    # outermost at each end (one below six values) have weights of their own.
    edge = "IF(n_total > 5, 2, 1)"
    ranks = _rank_chunks(ranked).selectExpr("column", "value", "n_total", "explode(sequence(_from, _to)) AS rank")
    scores = with_normal_ppf(ranks, {"m": share("rank")})
    ends = {"x1": "1", "x2": "2", "xm": "n_total - 1", "xn": "n_total"}
    sums = scores.groupBy("column").agg(
        F.expr("max(n_total) AS n_total"),
        F.expr("sum(m * m) AS m2"),
        F.expr(f"sum(IF(rank > {edge} AND rank <= n_total - {edge}, m * value, 0D)) AS mx"),
        *[F.expr(f"max(IF(rank = {r}, value, NULL)) AS {x}") for x, r in ends.items()],
    )
    sums = sums.join(F.broadcast(stats), "column")  # one row per column
    sums = with_normal_ppf(sums, {"m_last": share("n_total"), "m_next": share("(n_total - 1)")})
    steps = [
        {"_n": "CAST(n_total AS DOUBLE)", "_u": "1D / sqrt(CAST(n_total AS DOUBLE))"},
        {
            "a_last": f"IF(n_total = 3, {double(math.sqrt(0.5))}, {polynomial('_u', LAST_WEIGHT)} + try_divide(m_last, sqrt(m2)))",
            "a_next": f"{polynomial('_u', NEXT_WEIGHT)} + try_divide(m_next, sqrt(m2))",
        },
        {
            "scale": "IF(n_total > 5, "
            "try_divide(m2 - 2 * m_last * m_last - 2 * m_next * m_next, 1 - 2 * a_last * a_last - 2 * a_next * a_next), "
            "try_divide(m2 - 2 * m_last * m_last, 1 - 2 * a_last * a_last))"
        },
        {
            "numerator": "IF(n_total = 3, 0D, try_divide(mx, sqrt(scale))) + a_last * (xn - x1) + IF(n_total > 5, a_next * (xm - x2), 0D)"
        },
        {
            "shapiro_stat": f"CASE WHEN n_total >= 3 AND std >= {double(TINY_DEVIATION)} "
            "THEN least(numerator * numerator / (std * std * (_n - 1)), 1D) END"
        },
    ]
    for step in steps:
        sums = with_expressions(sums, step)
    tested = _with_shapiro_pvalue(sums)
    return tested.selectExpr("column", "n_total AS n", "shapiro_stat", "shapiro_pvalue")


def _with_shapiro_pvalue(sums: DataFrame) -> DataFrame:
    """Royston's normalising transformations; three values have a closed form."""
    small = f"(-ln(_gamma - _y) - {polynomial('_n', SMALL_MU)}) / exp({polynomial('_n', SMALL_SIGMA)})"
    large = f"(_y - {polynomial('_ln', LARGE_MU)}) / exp({polynomial('_ln', LARGE_SIGMA)})"
    three = f"greatest({double(6 / math.pi)} * (asin(sqrt(shapiro_stat)) - {double(math.asin(math.sqrt(0.75)))}), 0D)"
    steps = [
        {"_y": "IF(shapiro_stat < 1, ln(1D - shapiro_stat), NULL)", "_ln": "ln(_n)", "_gamma": polynomial("_n", SMALL_GAMMA)},
        {"_z": f"-(CASE WHEN _n > 11 THEN {large} WHEN _y < _gamma THEN {small} END)"},
        {"_cdf": normal_cdf("_z")},
        {
            "shapiro_pvalue": f"CASE WHEN shapiro_stat IS NULL THEN NULL WHEN shapiro_stat >= 1 THEN 1D "
            f"WHEN _n = 3 THEN {three} WHEN _n <= 11 AND _y >= _gamma THEN {double(1e-99)} ELSE _cdf END"
        },
    ]
    for step in steps:
        sums = with_expressions(sums, step)
    return sums


def with_kolmogorov_pvalue(df: DataFrame, d: str, n: str, output: str) -> DataFrame:
    """Upper tail of the two-sided statistic: Kolmogorov's series with Vrbik's finite-sample shift (2018)."""
    # Two forms of the same series; each converges fast on its side.
    tail = " + ".join(f"{double(2.0 * (-1) ** (k - 1))} * exp({double(-2.0 * k * k)} * _t * _t)" for k in range(1, 6))
    head = " + ".join(f"exp({double(-((2 * k - 1) ** 2) * math.pi**2 / 8)} / (_t * _t))" for k in range(1, 5))
    low = f"1D - {double(math.sqrt(2 * math.pi))} / _t * ({head})"
    steps = [
        {"_root": f"sqrt(CAST({n} AS DOUBLE))"},
        {"_t": f"_root * {d} + 1D / (6D * _root) + (_root * {d} - 1D) / (4D * {n})"},
        {output: f"least(greatest(CASE WHEN _t < 1D THEN {low} WHEN _t >= 1D THEN {tail} END, 0D), 1D)"},
    ]
    for step in steps:
        df = with_expressions(df, step)
    # least and greatest skip nulls.
    return with_expressions(df, {output: f"IF({d} IS NULL, NULL, {output})"}).drop("_root", "_t")


def ks_normal(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, ks_stat, ks_pvalue`` against a normal with the sample mean and deviation."""
    return _ks(_ranked(df, columns), moments(df, columns))


def _ks(ranked: DataFrame, stats: DataFrame) -> DataFrame:
    joined = ranked.join(F.broadcast(stats.select("column", "mean", "std")), "column")  # one row per column
    placed = with_expressions(joined, {"_z": "try_divide(value - mean, std)"})
    placed = with_expressions(placed, {"_cdf": normal_cdf("_z")})
    found = placed.groupBy("column").agg(
        F.expr("max(n_total) AS n"),
        F.expr("max(std) AS std"),
        F.expr("max(greatest(n_upto / n_total - _cdf, _cdf - n_before / n_total)) AS _d"),
    )
    found = with_expressions(found, {"ks_stat": f"IF(n >= 3 AND std >= {double(TINY_DEVIATION)}, _d, NULL)"})
    return with_kolmogorov_pvalue(found, "ks_stat", "n", "ks_pvalue").select("column", "n", "ks_stat", "ks_pvalue")


def normality_report(df: DataFrame, columns: list[str], alpha: float = ALPHA) -> DataFrame:
    """One row per column: moments, both tests and the recommendation."""
    ranked, stats = _ranked(df, columns), moments(df, columns)
    both = (
        stats.join(F.broadcast(_shapiro(ranked, stats).drop("n")), "column", "left")
        .join(F.broadcast(_ks(ranked, stats).drop("n")), "column", "left")
        .withColumns({"shapiro_normal": F.col("shapiro_pvalue") >= alpha, "ks_normal": F.col("ks_pvalue") >= alpha})
    )
    enough = F.col("n") >= 3
    yes_s, yes_k = F.coalesce("shapiro_normal", F.lit(False)), F.coalesce("ks_normal", F.lit(False))
    return both.withColumns(
        {
            "mean": F.when(enough, F.col("mean")),
            "std": F.when(enough, F.col("std")),
            "is_normal": yes_s & yes_k,
            "recommendation": F.when(~enough, "insufficient_data")
            .when(yes_s & yes_k, "use_zscore")
            .when(yes_s | yes_k, "use_zscore_with_caution")
            .otherwise("use_alternative_method"),
        }
    )


def normality_summary(df: DataFrame, columns: list[str], alpha: float = ALPHA) -> DataFrame:
    """The report's headline columns."""
    return normality_report(df, columns, alpha).select(
        "column", F.col("n").alias("sample_size"), "shapiro_pvalue", "ks_pvalue", "is_normal", "recommendation"
    )


def should_use_zscore(df: DataFrame, columns: list[str], alpha: float = ALPHA) -> DataFrame:
    return normality_report(df, columns, alpha).select(
        "column", F.col("recommendation").isin("use_zscore", "use_zscore_with_caution").alias("use_zscore")
    )


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """``rank, theoretical, sample`` per value; no rows below 3 values."""
    ranked = _ranked(df, [column]).join(F.broadcast(moments(df, [column]).select("column", "mean", "std")), "column")
    ranks = _rank_chunks(ranked.where(F.col("n_total") >= 3))
    share = "0.01D + 0.98D * (rank - 1) / (n_total - 1)"
    points = ranks.selectExpr(
        "explode(sequence(_from, _to)) AS rank", "n_total", "try_divide(value - mean, std) AS sample"
    )
    return with_normal_ppf(points, {"theoretical": share}).select("rank", "theoretical", "sample")


def qq_line(points: DataFrame) -> DataFrame:
    """End points of the reference line."""
    return points.agg(
        F.least(F.min("theoretical"), F.min("sample")).alias("line_min"),
        F.greatest(F.max("theoretical"), F.max("sample")).alias("line_max"),
    )


def iqr_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, q1, q3, iqr, lower_bound, upper_bound``; nulls below 4 values."""
    q = exact_quantiles(df, columns, {"q1": 0.25, "q3": 0.75})
    enough = F.col("n") >= 4
    q1, q3 = F.when(enough, F.col("q1")), F.when(enough, F.col("q3"))
    return q.select(
        "column",
        q1.alias("q1"),
        q3.alias("q3"),
        (q3 - q1).alias("iqr"),
        (q1 - 1.5 * (q3 - q1)).alias("lower_bound"),
        (q3 + 1.5 * (q3 - q1)).alias("upper_bound"),
    )


def outlier_flags(df: DataFrame, column: str, method: str = "auto", alpha: float = ALPHA) -> DataFrame:
    """Add ``is_outlier`` and ``outlier_method``: |z| > 3 where a z-score is allowed, else outside the IQR bounds."""
    chosen = (
        should_use_zscore(df, [column], alpha).select(F.when(F.col("use_zscore"), "zscore").otherwise("iqr")).scalar()
        if method == "auto"
        else F.lit(method)
    )
    stats = moments(df, [column]).select(F.struct("mean", "std")).scalar()
    bounds = iqr_bounds(df, [column]).select(F.struct("lower_bound", "upper_bound")).scalar()
    value = F.col(column)
    far = F.abs(F.try_divide(value - F.col("_s.mean"), F.col("_s.std"))) > 3
    outside = (value < F.col("_b.lower_bound")) | (value > F.col("_b.upper_bound"))
    return (
        df.withColumns({"outlier_method": chosen, "_s": stats, "_b": bounds})
        .withColumn("is_outlier", flag(F.when(F.col("outlier_method") == "zscore", far).otherwise(outside)))
        .drop("_s", "_b")
    )
