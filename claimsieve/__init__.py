"""Insurance-claim fraud analytics on Spark: DataFrame in, DataFrame out."""

from .plans.pipeline import prepare_claims, prepare_single_claim, score_claim, score_claims, score_prepared
from .session import build_session

__all__ = [
    "build_session",
    "prepare_claims",
    "prepare_single_claim",
    "score_claim",
    "score_claims",
    "score_prepared",
]
