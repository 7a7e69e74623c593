"""Column mapping and claim identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ROW_INDEX

# --- fixed values: name fragments that identify a field in an upload ---------
FIELD_TERMS = {
    "claim_id": ["claim", "policy", "id"],
    "total_claim_amount": ["amount", "claim", "value", "cost"],
    "incident_hour_of_the_day": ["hour", "time"],
    "age": ["age"],
    "incident_type": ["type"],
    "incident_severity": ["severity"],
    "witnesses": ["witness"],
    "property_damage": ["property"],
    "police_report_available": ["police"],
}


def infer_column_mapping(columns: list[str], skip_taken: bool = False) -> dict[str, str]:
    """Map each field to the first column whose name contains one of its terms.

    The id falls back to the first column. With ``skip_taken`` a column that
    already serves an earlier field is not offered again.
    """
    mapping: dict[str, str] = {}
    for field, terms in FIELD_TERMS.items():
        taken = set(mapping.values()) if skip_taken else set()
        hit = next((c for c in columns if c not in taken and any(t in c.lower() for t in terms)), None)
        if hit is None and field == "claim_id" and columns:
            hit = columns[0]
        if hit is not None:
            mapping[field] = hit
    return mapping


def map_columns(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Rename source columns to their target; the last target of a source wins, others stay."""
    targets = {source: target for target, source in mapping.items() if source in df.columns}
    taken = set(targets.values())
    return df.select(
        *[
            F.col(f"`{c}`").alias(targets.get(c, c))
            for c in df.columns
            if c in targets or c not in taken
        ]
    )


def ensure_required(df: DataFrame) -> DataFrame:
    """Fill in a missing id column (from the row index) and hour column; the amount must exist."""
    if "total_claim_amount" not in df.columns:
        raise ValueError("Required column 'total_claim_amount' not found in data")
    if "claim_id" not in df.columns:
        df = df.withColumn("claim_id", F.concat(F.lit("CLM_"), F.col(ROW_INDEX).cast("string")))
    if "incident_hour_of_the_day" not in df.columns:
        df = df.withColumn("incident_hour_of_the_day", F.lit(12))
    return df


def repeated_ids(df: DataFrame, key: str = "claim_id") -> DataFrame:
    """``key, first_idx, n`` of the ids that occur more than once; nulls are one group."""
    return (
        df.groupBy(key)
        .agg(F.min(ROW_INDEX).alias("first_idx"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )


def dedupe_claim_ids(df: DataFrame) -> DataFrame:
    """Keep the first occurrence of an id, suffix later ones with ``_dup_<row index>``.

    Ids are reduced map-side to (first index, count) and only repeated ids are
    joined back: usually a small set that AQE broadcasts. A hot id is skewed on
    the claims side of a left join only, which AQE splits.
    """
    repeated = repeated_ids(df).select(F.col("claim_id").alias("_id"), F.col("first_idx").alias("_first"))
    later = F.col("_first").isNotNull() & (F.col(ROW_INDEX) != F.col("_first"))
    # A null id prints as "nan" once it gets a suffix.
    renamed = F.concat(
        F.coalesce(F.col("claim_id").cast("string"), F.lit("nan")), F.lit("_dup_"), F.col(ROW_INDEX).cast("string")
    )
    return (
        df.join(repeated, F.col("claim_id").eqNullSafe(F.col("_id")), "left")
        .withColumn("claim_id", F.when(later, renamed).otherwise(F.col("claim_id").cast("string")))
        .drop("_id", "_first")
    )


def count_duplicate_ids(df: DataFrame, key: str = "claim_id") -> DataFrame:
    """One row: occurrences of ids beyond the first of each."""
    return repeated_ids(df, key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_ids"))


def has_repeated_ids(df: DataFrame, key: str = "claim_id") -> Column:
    """Scalar subquery: does any id occur twice?"""
    return repeated_ids(df, key).agg((F.count("*") > 0).alias("repeated")).scalar()
