"""Features derived from one cleaned claim, plus the batch digit statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.numbers import bin_text, digit_text, flag_text
from ..functions.text import map_literal, quoted, with_expressions

_STATES = ", ".join(quoted(s) for s in S.HIGH_RISK_STATES)

#: feature → (input columns it needs, SQL). Order is the output order.
ROW_FEATURES = {
    "log_claim_amount": (["total_claim_amount"], "log1p(total_claim_amount)"),
    "amount_category": (["total_claim_amount"], bin_text("total_claim_amount", S.AMOUNT_BINS, 0)),
    "is_round_amount": (["total_claim_amount"], flag_text("total_claim_amount % 1000 = 0")),
    "hour_category": (["incident_hour_of_the_day"], bin_text("incident_hour_of_the_day", S.HOUR_BINS, -1)),
    "unusual_hour": (
        ["incident_hour_of_the_day"],
        flag_text("incident_hour_of_the_day >= 22 OR incident_hour_of_the_day <= 5"),
    ),
    "age_group": (["age"], bin_text("age", S.AGE_BINS, 0)),
    "young_driver": (["age"], flag_text("age < 25")),
    "severity_numeric": (
        ["incident_severity"],
        f"CAST(coalesce(try_element_at({map_literal(S.SEVERITY_CODES)}, incident_severity), 1) AS DOUBLE)",
    ),
    "high_risk_state": (["incident_state"], flag_text(f"incident_state IN ({_STATES})")),
    "first_digit": (["total_claim_amount"], digit_text("total_claim_amount")),
    "amount_per_age": (["total_claim_amount", "age"], "try_divide(total_claim_amount, age)"),
    "high_amount_no_witnesses": (
        ["total_claim_amount", "witnesses"],
        flag_text("total_claim_amount > 50000 AND witnesses = 0"),
    ),
}


def row_features(df: DataFrame) -> DataFrame:
    """Add every row-wise feature whose inputs exist; absent optional inputs switch theirs off."""
    have = set(df.columns)
    return with_expressions(df, {n: sql for n, (needs, sql) in ROW_FEATURES.items() if have.issuperset(needs)})


def _digit_counts(df: DataFrame) -> DataFrame:
    """One row: ``n`` and the count of each leading digit; partial counts per task, no grouping shuffle."""
    digits = df.selectExpr(f"{digit_text('total_claim_amount')} AS digit")
    return digits.agg(F.count("*").alias("n"), *[F.expr(f"count_if(digit = {d}) AS d{d}") for d in S.BENFORD_SHARES])


def benford_anomaly_score(df: DataFrame) -> DataFrame:
    """One row: summed distance between observed and expected leading digit shares."""
    gaps = [f"abs({e}D - coalesce(try_divide(d{d}, n), 0D))" for d, e in S.BENFORD_SHARES.items()]
    return _digit_counts(df).selectExpr(f"{' + '.join(gaps)} AS benford_anomaly_score")


def benford_digit_table(df: DataFrame) -> DataFrame:
    """Expected and actual share per digit 1..9."""
    rows = ", ".join(
        f"named_struct('digit', {d}L, 'expected', {e}D, 'actual', coalesce(try_divide(d{d}, n), 0D))"
        for d, e in S.BENFORD_SHARES.items()
    )
    return _digit_counts(df).selectExpr(f"inline(array({rows}))")


def engineer_features(df: DataFrame) -> DataFrame:
    """Row features plus the batch digit score.

    The score is a scalar subquery over the amount column alone, so every row gets
    it as a constant: no join and no window over the batch.
    """
    return row_features(df).withColumn("benford_anomaly_score", benford_anomaly_score(df).scalar())


def numeric_features(df: DataFrame, order: list[str] = S.MODEL_FEATURES) -> list[str]:
    """Model features present in ``df`` with a numeric type, in model order."""
    types = {f.name: f.dataType for f in df.schema}
    return [c for c in order if isinstance(types.get(c), T.NumericType)]


def align_features(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Exactly ``columns`` as doubles, in order; absent features and nulls are 0."""
    have = set(df.columns)
    return df.selectExpr(
        *[f"`{c}`" for c in keep or []],
        *[f"{f'coalesce(CAST(`{c}` AS DOUBLE), 0D)' if c in have else '0D'} AS `{c}`" for c in columns],
    )
