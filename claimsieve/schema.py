"""Canonical claim columns and the fixed values of the scoring model."""

from __future__ import annotations

from pyspark.sql import types as T

ROW_INDEX = "row_idx"

REQUIRED_COLUMNS = ["claim_id", "total_claim_amount", "incident_hour_of_the_day"]
OPTIONAL_COLUMNS = [
    "age",
    "incident_state",
    "incident_severity",
    "incident_type",
    "witnesses",
    "police_report_available",
    "property_damage",
]

CLAIM_SCHEMA = T.StructType(
    [
        T.StructField("claim_id", T.StringType()),
        T.StructField("total_claim_amount", T.DoubleType()),
        T.StructField("incident_hour_of_the_day", T.DoubleType()),
        T.StructField("age", T.DoubleType()),
        T.StructField("incident_state", T.StringType()),
        T.StructField("incident_severity", T.StringType()),
        T.StructField("incident_type", T.StringType()),
        T.StructField("witnesses", T.DoubleType()),
        T.StructField("police_report_available", T.StringType()),
        T.StructField("property_damage", T.StringType()),
    ]
)

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("claim_id", T.StringType()),
        T.StructField("total_claim_amount", T.DoubleType()),
        T.StructField("final_risk_score", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("fraud_prediction", T.StringType()),
        T.StructField("ml_fraud_probability", T.DoubleType()),
        T.StructField("explanation", T.StringType()),
    ]
)

# --- fixed values: cleaning defaults and limits -----------------------------
DEFAULT_HOUR, HOUR_RANGE = 12.0, (0.0, 23.0)
DEFAULT_AGE, AGE_RANGE = 35.0, (18.0, 100.0)
DEFAULT_WITNESSES, WITNESS_RANGE = 1.0, (0.0, 10.0)

# --- fixed values: feature bins (upper bound inclusive, label) --------------
AMOUNT_BINS = [(5000, "Very Low"), (20000, "Low"), (50000, "Medium"), (100000, "High"), (None, "Very High")]
HOUR_BINS = [(6, "Night"), (12, "Morning"), (18, "Afternoon"), (24, "Evening")]
AGE_BINS = [(25, "Young"), (35, "Young Adult"), (50, "Middle Age"), (65, "Senior"), (100, "Elderly")]

# --- fixed values: encodings -------------------------------------------------
SEVERITY_CODES = {"Minor Damage": 1, "Major Damage": 2, "Total Loss": 3}
HIGH_RISK_STATES = ["NY", "CA", "FL", "TX"]
BENFORD_SHARES = {1: 0.301, 2: 0.176, 3: 0.125, 4: 0.097, 5: 0.079, 6: 0.067, 7: 0.058, 8: 0.051, 9: 0.046}

# --- fixed values: rule weights, in the order rules are evaluated ------------
RULE_WEIGHTS = {
    "z_score_outlier": 18,
    "benford_violation": 12,
    "very_suspicious_hour": 25,
    "unusual_hour": 15,
    "round_amount": 12,
    "extreme_amount": 30,
    "high_amount": 20,
    "young_high_claim": 28,
    "no_witnesses_high_claim": 22,
    "no_police_report": 25,
    "theft_no_police": 35,
    "total_loss_suspicious": 25,
    "severity_mismatch": 20,
}

# --- fixed values: score multipliers of dangerous pairs ----------------------
COMBO_MULTIPLIERS = [
    ("young_high_claim", "no_witnesses_high_claim", 1.4),
    ("young_high_claim", "unusual_hour", 1.3),
    ("extreme_amount", "no_police_report", 1.35),
    ("theft_no_police", "no_witnesses_high_claim", 1.5),
    ("very_suspicious_hour", "extreme_amount", 1.3),
    ("no_police_report", "total_loss_suspicious", 1.4),
]

# --- fixed values: model features --------------------------------------------
MODEL_FEATURES = [
    "total_claim_amount",
    "incident_hour_of_the_day",
    "log_claim_amount",
    "age",
    "unusual_hour",
    "is_round_amount",
    "young_driver",
    "severity_numeric",
    "high_risk_state",
    "benford_anomaly_score",
    "amount_per_age",
    "high_amount_no_witnesses",
    "witnesses",
    "first_digit",
]
PROFILE_FEATURES = [
    "total_claim_amount",
    "log_claim_amount",
    "is_round_amount",
    "incident_hour_of_the_day",
    "unusual_hour",
    "age",
    "young_driver",
    "severity_numeric",
    "high_risk_state",
    "benford_anomaly_score",
    "amount_per_age",
    "high_amount_no_witnesses",
    "witnesses",
    "first_digit",
]

# --- fixed values: ensemble weights ------------------------------------------
ENSEMBLE_WEIGHTS_FULL = {"lr": 0.25, "rf": 0.25, "knn": 0.20, "lgb": 0.15, "xgb": 0.15}
ENSEMBLE_WEIGHTS_CORE = {"lr": 0.35, "rf": 0.40, "knn": 0.25, "lgb": 0.0, "xgb": 0.0}
