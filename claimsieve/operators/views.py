"""Filters, ordering, previews, labels and display helpers of the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import number_text
from ..schema import ROW_INDEX


def filter_by_band(scored: DataFrame, bands: list[str], band: str = "risk_level") -> DataFrame:
    return scored.where(F.col(band).isin(bands))


def filter_by_prediction(scored: DataFrame, choice: str = "all") -> DataFrame:
    """``all``, ``fraud`` or ``legit``; both spellings of the prediction are known."""
    wanted = {"fraud": ["Fraud", "Y"], "legit": ["Legitimate", "N"]}
    if choice == "all":
        return scored
    return scored.where(F.col("fraud_prediction").isin(wanted[choice]))


def sort_results(scored: DataFrame, key: str = "score_desc") -> DataFrame:
    """``score_desc``, ``score_asc``, ``amount_desc`` or ``claim_id``; ties by claim id."""
    orders = {
        "score_desc": [F.desc("final_risk_score"), F.asc("claim_id")],
        "score_asc": [F.asc("final_risk_score"), F.asc("claim_id")],
        "amount_desc": [F.desc("total_claim_amount"), F.asc("claim_id")],
        "claim_id": [F.asc("claim_id")],
    }
    return scored.orderBy(*orders[key])


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` rows in upload order."""
    return df.orderBy(ROW_INDEX).limit(n)


def find_label_column(columns: list[str]) -> str | None:
    """First column whose name speaks of reported fraud."""
    return next((c for c in columns if "fraud" in c.lower() and "report" in c.lower()), None)


def normalize_fraud_label(label: Column) -> Column:
    """``Y``, ``N`` or null for anything that is neither."""
    text = F.btrim(F.lower(label.cast("string")), F.lit(" \t\n\r\f\v"))
    return F.when(text.isin("y", "yes", "1", "true", "t"), "Y").when(text.isin("n", "no", "0", "false", "f"), "N")


def binary_fraud_label(label: Column) -> Column:
    return F.when(F.upper(label.cast("string")) == "Y", 1).otherwise(0)


def normalize_police_report(value: Column) -> Column:
    """Map 0/1 and yes/no spellings to the codes the rules know; other text stays."""
    text = F.upper(F.trim(value.cast("string")))
    return F.when(text.isin("1", "1.0", "YES", "Y", "TRUE"), "YES").when(
        text.isin("0", "0.0", "NO", "N", "FALSE"), "NO"
    ).otherwise(text)


def format_incident_hour(df: DataFrame, column: str, minutes: bool = False) -> Column:
    """12-hour text such as ``2 PM`` or ``2:00 PM``; empty when the hour is no integer."""
    dtype = df.schema[column].dataType
    number = f"`{column}`" if isinstance(dtype, T.StringType) else number_text(column, dtype)
    number = f"try_cast({number} AS INT)"
    h = f"least(greatest({number}, 0), 23)"
    return F.expr(
        f"CASE WHEN {number} IS NULL THEN '' ELSE concat(CASE WHEN {h} % 12 = 0 THEN '12' ELSE CAST({h} % 12 AS STRING) END, "
        f"'{':00 ' if minutes else ' '}', CASE WHEN {h} < 12 THEN 'AM' ELSE 'PM' END) END"
    )


def label_match(prediction: Column, label: Column) -> Column:
    """``Match``/``Mismatch`` of a Y/N prediction where a label exists."""
    return F.when(label.isNotNull(), F.when(prediction == label, "Match").otherwise("Mismatch"))


def label_accuracy(results: DataFrame, label: str = "actual_fraud") -> DataFrame:
    """One row: percentage of labelled claims whose prediction agrees, and their number."""
    column = next(c for c in ("fraud_prediction", "final_prediction", "is_fraud") if c in results.columns)
    text = F.btrim(F.lower(F.col(column).cast("string")), F.lit(" \t\n\r\f\v"))
    predicted = F.when(text.isin("y", "yes", "1", "true", "t"), "Y").otherwise("N")
    return results.where(F.col(label).isin("Y", "N")).agg(
        F.count("*").alias("n_labelled"),
        (F.avg((predicted == F.col(label)).cast("double")) * 100).alias("accuracy_pct"),
    )
