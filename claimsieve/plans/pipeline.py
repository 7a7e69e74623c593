"""Preparing and scoring claims end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_claims
from ..operators.explain import add_explanations
from ..operators.features import engineer_features
from ..operators.fusion import combine_predictions, decide
from ..operators.mapping import dedupe_claim_ids, ensure_required, map_columns
from ..operators.rules import apply_rules
from ..schema import CLAIM_SCHEMA, ROW_INDEX


def prepare_claims(df: DataFrame, mapping: dict[str, str | None] | None = None) -> DataFrame:
    """Map → required columns → unique ids → clean → features.

    ``df`` needs a ``row_idx`` column: the position in the upload.
    """
    return engineer_features(clean_claims(dedupe_claim_ids(ensure_required(map_columns(df, mapping or {})))))


def prepare_single_claim(df: DataFrame) -> DataFrame:
    """Clean and derive features of claims entered by hand; ids are taken as they are."""
    return engineer_features(clean_claims(df))


def score_prepared(prepared: DataFrame, predict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rules, optional model, fusion, decision and texts on prepared claims.

    ``predict`` adds ``ml_fraud_prob`` to a frame, such as :meth:`Ensemble.predict`.
    Without it the rule score stands alone.
    """
    scored = apply_rules(prepared)
    if predict is None:
        scored = scored.withColumn("ml_fraud_prob", F.lit(None).cast("double"))
    else:
        scored = predict(scored)
    scored = decide(combine_predictions(scored)).withColumnRenamed("ml_fraud_prob", "ml_fraud_probability")
    return add_explanations(scored, parsed=True)


def score_claims(
    df: DataFrame,
    mapping: dict[str, str | None] | None = None,
    predict: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The whole batch as one lazy plan."""
    return score_prepared(prepare_claims(df, mapping), predict)


def claim_frame(spark: SparkSession, claim: dict) -> DataFrame:
    """One claim given as a dict, with the fields it has."""
    fields = [f for f in CLAIM_SCHEMA.fields if f.name in claim]
    schema = ", ".join(f"{f.name} string" for f in fields)
    values = tuple(None if claim[f.name] is None else str(claim[f.name]) for f in fields)
    return spark.createDataFrame([values], schema).withColumn(ROW_INDEX, F.lit(0).cast("bigint"))


def score_claim(
    spark: SparkSession, claim: dict, predict: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Score one claim with the batch operators."""
    return score_prepared(prepare_single_claim(claim_frame(spark, claim)), predict)
