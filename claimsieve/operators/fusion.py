"""Score fusion, risk bands and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clipped_text, number_text
from ..functions.text import literal, lookup

RULE_SHARE, MODEL_SHARE = 0.6, 0.4


def combined_score(rule_score: Column, probability: Column) -> Column:
    """60 % rules, 40 % model; the rule score alone where no probability is known."""
    blended = F.lit(RULE_SHARE) * rule_score + F.lit(MODEL_SHARE) * probability * F.lit(100)
    return F.when(probability.isNull() | F.isnan(probability), rule_score).otherwise(blended)


def combine_predictions(df: DataFrame, probability: str = "ml_fraud_prob") -> DataFrame:
    """Blend ``risk_score`` with a probability column of the same frame."""
    return df.withColumn("risk_score", combined_score(F.col("risk_score"), F.col(probability).cast("double")))


def join_predictions(df: DataFrame, predictions: DataFrame, probability: str = "ml_fraud_prob") -> DataFrame:
    """Attach one probability per claim id (left join), then blend; of several predictions of an id the highest counts."""
    one = predictions.groupBy("claim_id").agg(F.max(probability).alias(probability))
    return combine_predictions(df.join(one, "claim_id", "left"), probability)


def risk_level(score: Column) -> Column:
    """Low below 30, Medium below 70, else High; null stays null."""
    return F.when(score < 30, "Low").when(score < 70, "Medium").when(score >= 70, "High")


def fraud_prediction(score: Column, positive: str = "Fraud", negative: str = "Legitimate") -> Column:
    """Null stays null."""
    return F.when(score >= 70, positive).when(score < 70, negative)


def resolve_final_score(df: DataFrame) -> Column:
    """First usable of the three score columns, limited to 0..100; null when there is none."""
    types = {f.name: f.dataType for f in df.schema}
    found = [
        number_text(c, types[c]) for c in ("final_risk_score", "risk_score", "combined_score") if c in types
    ]
    return F.expr(clipped_text(f"coalesce({', '.join(found)})", 0.0, 100.0)) if found else F.lit(None).cast("double")


def decide(df: DataFrame) -> DataFrame:
    """Add ``final_risk_score``, ``risk_level`` and ``fraud_prediction``."""
    return df.withColumn("final_risk_score", F.col("risk_score").cast("double")).withColumns(
        {
            "risk_level": risk_level(F.col("final_risk_score")),
            "fraud_prediction": fraud_prediction(F.col("final_risk_score")),
        }
    )


# --- fixed values: follow-up sentences ---------------------------------------
BATCH_STEPS = {
    "High": "⛔ IMMEDIATE ACTION: Escalate to senior fraud investigator. Do not approve without thorough investigation.",
    "Medium": "⚠️ VERIFICATION REQUIRED: Request additional documentation and verify all witness statements before proceeding.",
    "Low": "✅ STANDARD PROCESS: Proceed with routine documentation review. Claim shows legitimate patterns.",
}
SINGLE_STEPS = {
    "High": "IMMEDIATE INVESTIGATION REQUIRED: Escalate to senior fraud investigator. Do not process this claim without thorough review.",
    "Medium": "ADDITIONAL VERIFICATION NEEDED: Request supporting documentation before processing. Verify witness statements and police reports.",
    "Low": "STANDARD PROCESSING APPROVED: Routine documentation review recommended. Claim appears legitimate.",
}


def next_step(level: Column, single: bool = False) -> Column:
    """Follow-up sentence of a level; anything but High and Medium reads as Low."""
    steps = SINGLE_STEPS if single else BATCH_STEPS
    return F.coalesce(lookup(steps, level), F.lit(steps["Low"]))


def triage_action(score: Column) -> Column:
    """Null stays null."""
    return F.when(score >= 70, "ESCALATE").when(score >= 40, "VERIFY").when(score < 40, "APPROVE")


# --- fixed values: recommended action per band -------------------------------
ACTIONS = {
    "high_risk": (
        "ESCALATE",
        "Immediate investigation required",
        [
            "Assign to senior fraud investigator",
            "Request additional documentation",
            "Verify incident details with authorities",
            "Consider claim suspension pending investigation",
            "Review claimant history for patterns",
        ],
    ),
    "medium_risk": (
        "VERIFY",
        "Additional verification recommended",
        [
            "Contact claimant for additional information",
            "Verify incident details with authorities",
            "Review supporting documentation carefully",
            "Check for similar recent claims",
            "Consider field inspection if warranted",
        ],
    ),
    "low_risk": (
        "APPROVE",
        "Standard processing recommended",
        [
            "Process claim through normal workflow",
            "Routine documentation review",
            "Standard settlement procedures",
            "Monitor for any additional red flags",
        ],
    ),
}


def action_recommendation(band: Column) -> Column:
    """Struct ``action, description, steps`` of a band such as ``High`` or ``high_risk``."""
    name = F.lower(band)
    name = F.when(name.endswith("_risk"), name).otherwise(F.concat(name, F.lit("_risk")))
    parts = [lookup({k: v[i] for k, v in ACTIONS.items()}, name) for i in range(3)]
    default = ACTIONS["low_risk"]
    return F.struct(
        F.coalesce(parts[0], F.lit(default[0])).alias("action"),
        F.coalesce(parts[1], F.lit(default[1])).alias("description"),
        F.coalesce(parts[2], F.expr(literal(default[2]))).alias("steps"),
    )
