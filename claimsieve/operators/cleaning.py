"""Numeric cleaning and entry validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numbers import clean_number, number_text
from ..functions.text import with_expressions

FILLED = {
    "incident_hour_of_the_day": (S.DEFAULT_HOUR, S.HOUR_RANGE),
    "age": (S.DEFAULT_AGE, S.AGE_RANGE),
    "witnesses": (S.DEFAULT_WITNESSES, S.WITNESS_RANGE),
}


def _cleaned(df: DataFrame, names: list[str]) -> DataFrame:
    """Numeric columns; gaps take the default, then values are limited to their range."""
    new = {}
    for f in df.schema:
        if f.name not in names:
            continue
        new[f.name] = number_text(f.name, f.dataType)
        if f.name in FILLED:
            default, (low, high) = FILLED[f.name]
            new[f.name] = f"least(greatest(coalesce({new[f.name]}, {default}D), {low}D), {high}D)"
    return with_expressions(df, new)


def clean_amount(df: DataFrame) -> DataFrame:
    """Numeric amount; rows without a positive amount are dropped."""
    return _cleaned(df, ["total_claim_amount"]).where("total_claim_amount > 0")


def clean_hour(df: DataFrame) -> DataFrame:
    return _cleaned(df, ["incident_hour_of_the_day"])


def clean_age(df: DataFrame) -> DataFrame:
    return _cleaned(df, ["age"])


def clean_witnesses(df: DataFrame) -> DataFrame:
    return _cleaned(df, ["witnesses"])


def clean_claims(df: DataFrame) -> DataFrame:
    return _cleaned(df, ["total_claim_amount", *FILLED]).where("total_claim_amount > 0")


# --- fixed values: messages shown for a rejected entry -----------------------
MISSING_FIELDS = "Please fill in all required fields (Claim ID, Amount, Hour)"
NOT_NUMERIC = "Please enter a numeric claim amount within the acceptable range (greater than zero pesos)."
NOT_POSITIVE = (
    "Claim amounts must be greater than zero pesos to be evaluated. "
    "Please update the value within the acceptable range."
)
FILTERED_OUT = (
    "We couldn't analyze this claim because preprocessing filtered it out "
    "(for example, due to a zero or negative claim amount). Please review the "
    "values and try again."
)


def with_reject_reason(df: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the message of the first failed entry check, else null."""
    missing = (
        F.col("claim_id").isNull()
        | (F.col("claim_id").cast("string") == "")
        | F.col("total_claim_amount").isNull()
        | F.col("incident_hour_of_the_day").isNull()
    )
    raw = F.col("total_claim_amount").try_cast("double")
    amount = clean_number("total_claim_amount", df.schema["total_claim_amount"].dataType)
    special = F.isnan(raw) | (F.abs(raw) == float("inf"))
    return df.withColumn(
        "reject_reason",
        F.when(missing, MISSING_FIELDS)
        .when(amount.isNull() & ~F.coalesce(special, F.lit(False)), NOT_NUMERIC)
        .when((amount <= 0) | (raw == -float("inf")), NOT_POSITIVE)
        .when(amount.isNull(), FILTERED_OUT),
    )


def validate_claims(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into accepted claims and rejected claims with their ``reject_reason``."""
    checked = with_reject_reason(df)
    return (
        checked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.where(F.col("reject_reason").isNotNull()),
    )
