"""Features over a policy's history and over the whole batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numbers import bin_text, clean_number, digit_text, flag
from ..functions.text import lookup, with_expressions
from ..plans.ordered import exact_quantiles, quantiles_of, value_distribution, with_running_totals

UNKNOWN = "UNKNOWN"
FREQUENT_CLAIMS, FREQUENT_DAYS = 3, 30


PARTS = ["injury_claim", "property_claim", "vehicle_claim", "total_claim_amount"]
PARTS_MEAN = f"(({' + '.join(PARTS)}) / 4D)"
PARTS_SQUARES = " + ".join(f"pow({p} - {PARTS_MEAN}, 2D)" for p in PARTS)

#: feature → (input columns, SQL). Monday is day 1; deviations are sample deviations.
ROW_FEATURES = {
    "incident_day_of_week": (["incident_date"], "weekday(incident_date) + 1"),
    "incident_month": (["incident_date"], "month(incident_date)"),
    "incident_hour_bin": (
        ["incident_hour_of_the_day"],
        bin_text("incident_hour_of_the_day", [(6, "Late Night"), (12, "Morning"), (18, "Afternoon"), (24, "Evening")], -1.0),
    ),
    "customer_tenure_years": (
        ["incident_date", "policy_bind_date"],
        "datediff(incident_date, policy_bind_date) / 365.25D",
    ),
    "claim_mean": (PARTS, PARTS_MEAN),
    "claim_std_dev": (PARTS, f"sqrt(({PARTS_SQUARES}) / 3D)"),
    "leading_digit": (["total_claim_amount"], digit_text("total_claim_amount")),
    "benford_flag": (
        ["total_claim_amount"],
        f"CASE WHEN {digit_text('total_claim_amount')} IN (8, 9) THEN 1 ELSE 0 END",
    ),
    # Hours 1 to 5, not the wider unusual_hour.
    "rule_unusual_hour": (
        ["incident_hour_of_the_day"],
        "CASE WHEN incident_hour_of_the_day BETWEEN 1 AND 5 THEN 1 ELSE 0 END",
    ),
    "rule_suspicious_missing": (
        ["police_report_available", "property_damage"],
        f"CASE WHEN upper(police_report_available) = '{UNKNOWN}' OR upper(property_damage) = '{UNKNOWN}' THEN 1 ELSE 0 END",
    ),
    "flag_no_authorities_contacted": (
        ["authorities_contacted"],
        "CASE WHEN authorities_contacted IS NULL OR authorities_contacted IN ('None', 'Not Reported') THEN 1 ELSE 0 END",
    ),
}


def row_dictionary_features(df: DataFrame) -> DataFrame:
    """The dictionary features of a claim by itself, where their inputs exist."""
    have = set(df.columns)
    out = with_expressions(df, {n: sql for n, (needs, sql) in ROW_FEATURES.items() if have.issuperset(needs)})
    return out.withColumn("benford_expected", lookup(S.BENFORD_SHARES, F.col("leading_digit")))


def policy_days(df: DataFrame, policy: str = "policy_number", day: str = "incident_date") -> DataFrame:
    """Per policy and claim day: first row index, days since the previous claim day, 30-day claim count.

    Claims are reduced to (policy, day) before anything is ordered, so a policy
    with a third of all claims has at most one row per calendar day in the window.
    """
    days = (
        df.where(F.col(day).isNotNull())
        .groupBy(policy, day)
        .agg(F.count("*").alias("_n"), F.min(S.ROW_INDEX).alias("_first"))
        .withColumn("_epoch", F.unix_date(day))
    )
    history = Window.partitionBy(policy).orderBy("_epoch")
    return days.withColumns(
        {
            "_gap": F.col("_epoch") - F.lag("_epoch").over(history),
            "claims_last_30d": F.sum("_n").over(history.rangeBetween(-FREQUENT_DAYS, 0)),
        }
    )


def policy_history(
    df: DataFrame, policy: str = "policy_number", day: str = "incident_date", source: DataFrame | None = None
) -> DataFrame:
    """Add ``days_since_last_claim`` (−1 for the first), ``claims_last_30d`` and ``rule_high_frequency``.

    Later claims of one day follow the earlier ones by row index and are 0 days after them.
    ``source`` is the same batch without columns added on the way, here and below:
    its statistics then do not compute those columns.
    """
    days = policy_days(df if source is None else source, policy, day).select(
        F.col(policy).alias("_policy"), F.col(day).alias("_day"), "_first", "_gap", "claims_last_30d"
    )
    same = F.col(policy).eqNullSafe(F.col("_policy")) & (F.col(day) == F.col("_day"))
    opening = F.col(S.ROW_INDEX) == F.col("_first")
    return (
        df.join(days, same, "left")
        .withColumns(
            {
                "days_since_last_claim": F.when(
                    F.col("_day").isNotNull(), F.when(opening, F.coalesce(F.col("_gap"), F.lit(-1))).otherwise(0)
                ),
                "rule_high_frequency": flag(F.col("claims_last_30d") > FREQUENT_CLAIMS),
            }
        )
        .drop("_policy", "_day", "_first", "_gap")
    )


def amount_zscore(df: DataFrame, column: str = "total_claim_amount", source: DataFrame | None = None) -> DataFrame:
    """Add ``zscore_total_claim`` (sample deviation) and ``anomaly_zscore`` (beyond ±3)."""
    value = clean_number(column, df.schema[column].dataType)
    source = df if source is None else source
    stats = source.agg(F.struct(F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).alias("stats"))
    return (
        df.withColumn("_stats", stats.scalar())
        .withColumn("zscore_total_claim", F.try_divide(value - F.col("_stats.m"), F.col("_stats.s")))
        .withColumn("anomaly_zscore", flag(F.abs("zscore_total_claim") > 3))
        .drop("_stats")
    )


def ranked_amounts(df: DataFrame, column: str = "total_claim_amount") -> DataFrame:
    """The distinct amounts of a batch with their counts and running counts."""
    return with_running_totals(value_distribution(df, [column]))


def percentile_rank(df: DataFrame, column: str = "total_claim_amount", ranked: DataFrame | None = None) -> DataFrame:
    """Add ``claim_percentile_rank``: average rank over the number of values."""
    ranked = ranked_amounts(df, column) if ranked is None else ranked
    ranks = ranked.selectExpr("value AS _value", "(n_before + 1 + n_upto) / 2D / n_total AS claim_percentile_rank")
    return df.join(ranks, clean_number(column, df.schema[column].dataType) == F.col("_value"), "left").drop("_value")


def iqr_flag(df: DataFrame, column: str = "total_claim_amount", ranked: DataFrame | None = None) -> DataFrame:
    """Add ``iqr_flag``: outside 1.5 interquartile ranges of the batch."""
    shares = {"q1": 0.25, "q3": 0.75}
    q = exact_quantiles(df, [column], shares) if ranked is None else quantiles_of(ranked, shares)
    q = q.where(F.col("n") >= 4)
    limits = q.agg(F.expr("first(named_struct('low', q1 - 1.5D * (q3 - q1), 'high', q3 + 1.5D * (q3 - q1))) AS b"))
    return (
        df.withColumn("_b", limits.scalar())
        .withColumn("iqr_flag", flag((F.col(column) < F.col("_b.low")) | (F.col(column) > F.col("_b.high"))))
        .drop("_b")
    )


def duplicate_amount(df: DataFrame, column: str = "total_claim_amount") -> DataFrame:
    """Add ``duplicate_amount``: another claim of the batch has the same amount.

    Only amounts seen twice are joined back.
    """
    repeated = (
        df.groupBy(column).agg(F.count("*").alias("_c")).where(F.col("_c") > 1).select(F.col(column).alias("_amount"))
    )
    return (
        df.join(repeated, F.col(column) == F.col("_amount"), "left")
        .withColumn("duplicate_amount", flag(F.col("_amount").isNotNull()))
        .drop("_amount")
    )


def dictionary_features(df: DataFrame) -> DataFrame:
    """Every dictionary feature whose inputs exist.

    One ranking of the amounts serves quartiles, percentile ranks and duplicates;
    the last two come back in a single join.
    """
    column = "total_claim_amount"
    ranked = ranked_amounts(df, column)
    out = amount_zscore(iqr_flag(row_dictionary_features(df), column, ranked), column, source=df)
    if {"policy_number", "incident_date"}.issubset(df.columns):
        out = policy_history(out, source=df)
    ranks = ranked.selectExpr(
        "value AS _value",
        "(n_before + 1 + n_upto) / 2D / n_total AS claim_percentile_rank",
        "IF(n > 1, 1, 0) AS duplicate_amount",
    )
    return out.join(ranks, clean_number(column, df.schema[column].dataType) == F.col("_value"), "left").drop("_value")
