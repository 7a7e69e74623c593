"""Joins of results with labels and uploads, and concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ROW_INDEX
from .mapping import dedupe_claim_ids, has_repeated_ids
from .views import normalize_fraud_label


def join_labels(results: DataFrame, labels: DataFrame, label: str = "fraud_reported", order: str = ROW_INDEX) -> DataFrame:
    """Left join of the normalised label by trimmed claim id.

    Several labels of one id are reduced to the first before the join, so results
    never fan out and the label side has one row per key.
    """
    one = (
        labels.select(
            F.trim(F.col("claim_id").cast("string")).alias("claim_id"),
            F.col(order).alias("_order"),
            normalize_fraud_label(F.col(label)).alias("_label"),
        )
        .groupBy("claim_id")
        .agg(F.min_by(F.struct("_label"), "_order").alias("_l"))
        .select("claim_id", F.col("_l._label").alias("actual_fraud"))
    )
    trimmed = results.withColumn("claim_id", F.trim(F.col("claim_id").cast("string")))
    return trimmed.join(one, "claim_id", "left")


def _unique_ids(df: DataFrame, key: str) -> DataFrame:
    suffixed = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("nan")), F.lit("_"), F.col(ROW_INDEX).cast("string"))
    return df.withColumn(key, F.when(has_repeated_ids(df, key), suffixed).otherwise(F.col(key).cast("string")))


def export_join(upload: DataFrame, results: DataFrame, key: str = "claim_id", prefix: str = "result_", literal_ids: bool = False) -> DataFrame:
    """Full outer join of upload and results on the claim id.

    Repeated ids of the upload are told apart as :func:`dedupe_claim_ids` does before
    scoring, so every scored claim meets its upload row. With ``literal_ids`` a side with repeated ids
    gets ``_<row index>`` appended to each of its ids instead, which matches nothing as soon as
    one id repeats. Result columns that clash take ``prefix``.
    """
    if literal_ids:
        left, right = _unique_ids(upload, key), _unique_ids(results, "claim_id")
    else:
        left = dedupe_claim_ids(upload.withColumnRenamed(key, "claim_id")).withColumnRenamed("claim_id", key)
        right = results
    right = right.drop(*([ROW_INDEX] if ROW_INDEX in results.columns else []))
    right = right.select(
        F.col("claim_id").alias("_rid"),
        *[F.col(c).alias(prefix + c if c in upload.columns else c) for c in right.columns if c != "claim_id"],
    )
    joined = left.join(right, F.col(key) == F.col("_rid"), "full_outer")
    return joined.withColumn(key, F.coalesce(F.col(key), F.col("_rid"))).drop("_rid")


def repeat_union(df: DataFrame, times: int, rows: int | None = None, order: str = ROW_INDEX) -> DataFrame:
    """``df`` concatenated ``times`` times with a new running index, optionally the first ``rows``.

    Copies are made in place by exploding a short sequence; the new index needs the
    row count only, as a scalar subquery.
    """
    size = df.agg(F.count("*").alias("n")).scalar()
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    out = copies.withColumn(order, F.col("_copy") * size + F.col(order)).drop("_copy")
    return out.orderBy(order).limit(rows) if rows is not None else out
