"""Every rule at its thresholds, combination multipliers, fusion, bands and texts."""

import pytest
from pyspark.sql import functions as F

from claimsieve.operators import explain, fusion
from claimsieve.operators.rules import apply_rules

CLEAR = {
    "total_claim_amount": 1234.0, "incident_hour_of_the_day": 12.0, "age": 40.0, "witnesses": 1.0, "police_report_available": "YES",
    "incident_type": "Parked Car", "incident_severity": "Minor Damage",
}

CASES = [
    ({}, [], 0),
    ({"total_claim_amount": 300000.0}, ["round_amount", "extreme_amount"], 42),
    ({"total_claim_amount": 300000.01}, ["z_score_outlier", "extreme_amount"], 48),
    ({"total_claim_amount": 8000.0}, ["benford_violation"], 12),
    ({"total_claim_amount": 0.9}, [], 0),
    ({"incident_hour_of_the_day": 1.0}, ["very_suspicious_hour"], 25),
    ({"incident_hour_of_the_day": 4.0}, ["very_suspicious_hour"], 25),
    ({"incident_hour_of_the_day": 5.0}, ["unusual_hour"], 15),
    ({"incident_hour_of_the_day": 0.0}, ["unusual_hour"], 15),
    ({"incident_hour_of_the_day": 5.5}, [], 0),
    ({"incident_hour_of_the_day": 21.0}, [], 0),
    ({"incident_hour_of_the_day": 22.0}, ["unusual_hour"], 15),
    ({"total_claim_amount": 50000.0}, ["round_amount"], 12),
    ({"total_claim_amount": 70000.0}, [], 0),
    ({"total_claim_amount": 110000.0}, ["round_amount"], 12),
    ({"total_claim_amount": 149999.0}, [], 0),
    ({"total_claim_amount": 150001.0}, ["high_amount"], 20),
    ({"total_claim_amount": 249999.99}, ["high_amount"], 20),
    ({"age": 24.0, "total_claim_amount": 100001.0}, ["young_high_claim"], 28),
    ({"age": 25.0, "total_claim_amount": 100001.0}, [], 0),
    ({"witnesses": 0.0, "total_claim_amount": 150001.0}, ["high_amount", "no_witnesses_high_claim"], 42),
    ({"police_report_available": "UNKNOWN"}, ["no_police_report"], 25),
    ({"police_report_available": "no"}, [], 0),
    ({"police_report_available": None}, [], 0),
    ({"incident_type": "Vehicle THEFT"}, [], 0),
    ({"incident_type": "Vehicle THEFT", "police_report_available": "N"}, ["no_police_report", "theft_no_police"], 60),
    ({"incident_severity": "Major Damage"}, ["total_loss_suspicious"], 25),
    ({"incident_severity": "Total Loss", "witnesses": 0.0}, ["total_loss_suspicious", "severity_mismatch"], 45),
    # combinations
    ({"age": 20.0, "total_claim_amount": 160001.0, "witnesses": 0.0}, ["high_amount", "young_high_claim", "no_witnesses_high_claim"], 70 * 1.4),
    ({"age": 20.0, "total_claim_amount": 100001.0, "incident_hour_of_the_day": 23.0}, ["unusual_hour", "young_high_claim"], 43 * 1.3),
    ({"total_claim_amount": 250001.0, "police_report_available": "NO"}, ["extreme_amount", "no_police_report"], 55 * 1.35),
    ({"total_claim_amount": 250001.0, "incident_hour_of_the_day": 2.0}, ["very_suspicious_hour", "extreme_amount"], 55 * 1.3),
    ({"incident_severity": "Total Loss", "police_report_available": "NO"}, ["no_police_report", "total_loss_suspicious"], 50 * 1.4),
    (
        {"total_claim_amount": 160001.0, "witnesses": 0.0, "police_report_available": "NO", "incident_type": "theft"},
        ["high_amount", "no_witnesses_high_claim", "no_police_report", "theft_no_police"],
        100,
    ),
]


def test_rule_cases(spark):
    schema = "row_idx long, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in CLEAR.items())
    data = [(i, *({**CLEAR, **change}.values())) for i, (change, _, _) in enumerate(CASES)]
    found = apply_rules(spark.createDataFrame(data, schema)).orderBy("row_idx").collect()
    for row, (change, indicators, score) in zip(found, CASES):
        assert row["top_indicators"] == indicators, change
        assert row["risk_score"] == pytest.approx(score), change
        assert row["triggered_rules"] == ", ".join(indicators)


def test_absent_fields_take_defaults(spark):
    found = apply_rules(spark.createDataFrame([(99999.0,)], "total_claim_amount double")).first()
    assert found["top_indicators"] == ["benford_violation"]


def test_fusion_and_bands(spark):
    frame = spark.createDataFrame(
        [(50.0, 0.5), (50.0, None), (50.0, float("nan")), (29.999, None), (30.0, None), (69.99, None), (70.0, None)],
        "risk_score double, ml_fraud_prob double",
    )
    out = fusion.combine_predictions(frame)
    assert [r[0] for r in out.select("risk_score").collect()[:3]] == [50.0, 50.0, 50.0]
    levels = [r[0] for r in frame.select(fusion.risk_level(F.col("risk_score"))).collect()]
    assert levels[3:] == ["Low", "Medium", "Medium", "High"]
    actions = [r[0] for r in frame.select(fusion.triage_action(F.col("risk_score"))).collect()]
    assert actions[3:] == ["APPROVE", "APPROVE", "VERIFY", "ESCALATE"]
    nothing = spark.createDataFrame([(None,)], "s double").select(fusion.risk_level(F.col("s"))).first()[0]
    assert nothing is None


def test_texts(spark):
    frame = spark.createDataFrame(
        [
            ("a", None, " x , ,y ", 85.0, "High", 0.8),
            ("b", ["only"], None, 30.0, "Medium", 0.5),
            ("c", [], None, 10.0, None, 0.0),
            ("d", [" "], "z", 70.125, "High", None),
        ],
        "claim_id string, top_indicators array<string>, triggered_rules string, final_risk_score double, risk_level string, ml_fraud_probability double",
    )
    out = {r["claim_id"]: r for r in explain.add_explanations(frame).collect()}
    assert out["a"]["top_indicators"] == ["x", "y"]
    assert out["a"]["reason_1"] == "Analysis detected: x" and out["a"]["reason_2"] == "Secondary concern: y"
    assert "85.00/100 indicates very high" in out["a"]["explanation"] and "2 fraud indicators" in out["a"]["explanation"]
    assert out["a"]["explanation"].endswith("strongly suggest fraudulent activity.")
    assert out["b"]["reason_2"] == explain.ONE_RULE_SECOND and "One fraud indicator" in out["b"]["explanation"]
    assert out["c"]["reason_1"] == explain.NO_RULE_REASON and out["c"]["explanation"].endswith("within normal ranges.")
    assert out["d"]["top_indicators"] == ["z"] and "70.12/100" in out["d"]["explanation"]


def test_insights_of_nothing(spark):
    empty = spark.createDataFrame([], "claim_id string, top_indicators array<string>, final_risk_score double, risk_level string")
    assert explain.summary_insights(empty).first()[0] == explain.NOTHING_ANALYZED
