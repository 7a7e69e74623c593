"""Mapping, identifiers, cleaning, validation and features on hand-written claims."""

import math

import pytest
from pyspark.sql import functions as F

from claimsieve.operators import cleaning, features, mapping, views
from claimsieve.operators.fusion import resolve_final_score
from claimsieve.operators.joins import export_join, join_labels, repeat_union
from claimsieve.operators.profile import missing_pct, outlier_pct, profile_upload, quality_score
from claimsieve.plans.pipeline import prepare_claims, score_claim, score_claims

AMOUNTS = [None, "0", "-5", "abc", "NaN", "inf", "5d", "1e999", "0.5", "0.00005", "1000", "9999.99", "50000", "100000", "250000", "1e20"]


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("row_idx").select(*columns).collect()]


def test_uploaded_names_are_mapped_before_features(spark):
    """Three claims at the edges of the bins, with upload names of another system and texts where numbers belong."""
    raw = spark.createDataFrame(
        [
            (0, "2024-0017", "5000", "24", "64", None, "2"),
            (1, "2024-0018", "5000.01", "-3", "65", "Total Loss", "11"),
            (2, "2024-0019", "93000", None, "17", "scratch", None),
        ],
        "row_idx long, Vorgang string, Schadenhoehe string, Stunde string, Alter string, Schwere string, Zeugen string",
    )
    upload = {
        "claim_id": "Vorgang", "total_claim_amount": "Schadenhoehe", "incident_hour_of_the_day": "Stunde", "age": "Alter",
        "incident_severity": "Schwere", "witnesses": "Zeugen",
    }
    out = prepare_claims(raw, upload)
    assert not {"Vorgang", "Schadenhoehe", "Stunde", "high_risk_state"} & set(out.columns)
    assert rows(out, "claim_id", "incident_hour_of_the_day", "age", "witnesses") == [
        ("2024-0017", 23.0, 64.0, 2.0), ("2024-0018", 0.0, 65.0, 10.0), ("2024-0019", 12.0, 18.0, 1.0)
    ]
    assert rows(out, "amount_category", "hour_category", "age_group", "unusual_hour", "young_driver", "is_round_amount", "first_digit", "severity_numeric") == [
        ("Very Low", "Evening", "Senior", 1, 0, 1, 5, 1.0),
        ("Low", "Night", "Senior", 1, 0, 0, 5, 3.0),
        ("High", "Morning", "Young", 0, 1, 1, 9, 1.0),
    ]


def test_missing_columns(spark):
    frame = spark.createDataFrame([(0, "A1", 12), (1, "A2", 3)], "row_idx long, claim_id string, incident_hour_of_the_day int")
    with pytest.raises(ValueError, match="Required column"):
        prepare_claims(frame, {})
    only_amount = spark.createDataFrame([(0, 5.0), (1, 6.0)], "row_idx long, total_claim_amount double")
    assert rows(prepare_claims(only_amount), "claim_id", "incident_hour_of_the_day") == [("CLM_0", 12.0), ("CLM_1", 12.0)]


def test_mapping_last_target_wins_and_inference(spark):
    frame = spark.createDataFrame([(1, 2)], "a int, b int")
    assert mapping.map_columns(frame, {"x": "a", "y": "a", "z": "missing"}).columns == ["y", "b"]
    assert mapping.map_columns(frame, {"a": "b", "b": "a"}).columns == ["b", "a"]
    found = mapping.infer_column_mapping(["Policy", "Loss_Amount", "EventTime", "Age", "kind_type"])
    assert found == {
        "claim_id": "Policy", "total_claim_amount": "Loss_Amount", "incident_hour_of_the_day": "EventTime", "age": "Age",
        "incident_type": "kind_type",
    }
    # Without skip_taken the id column also offers itself as an amount.
    assert mapping.infer_column_mapping(["claim_id", "amount"])["total_claim_amount"] == "claim_id"
    assert mapping.infer_column_mapping(["claim_id", "amount"], skip_taken=True)["total_claim_amount"] == "amount"


def test_duplicate_ids(spark):
    ids = ["x", None, "y", "x", None, "x"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "row_idx long, claim_id string").repartition(3)
    out = mapping.dedupe_claim_ids(frame)
    assert [r[0] for r in rows(out, "claim_id")] == ["x", None, "y", "x_dup_3", "nan_dup_4", "x_dup_5"]
    assert mapping.count_duplicate_ids(frame).first()[0] == 3


def test_amount_edges(spark):
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(AMOUNTS)], "row_idx long, total_claim_amount string")
    kept = rows(features.row_features(cleaning.clean_amount(frame)), "total_claim_amount", "first_digit")
    assert kept == [
        (0.5, 0), (0.00005, 5), (1000.0, 1), (9999.99, 9), (50000.0, 5), (100000.0, 1), (250000.0, 2), (1e20, 1),
    ]


def test_numbers_are_filled_and_clipped(spark):
    frame = spark.createDataFrame(
        [(0, None, None, None), (1, -3.0, 10.0, -1.0), (2, 40.0, 140.0, 99.0), (3, 5.5, 18.0, 0.0), (4, math.nan, math.inf, math.nan)],
        "row_idx long, incident_hour_of_the_day double, age double, witnesses double",
    )
    out = cleaning.clean_witnesses(cleaning.clean_age(cleaning.clean_hour(frame)))
    assert rows(out, "incident_hour_of_the_day", "age", "witnesses") == [
        (12.0, 35.0, 1.0), (0.0, 18.0, 0.0), (23.0, 100.0, 10.0), (5.5, 18.0, 0.0), (12.0, 35.0, 1.0),
    ]


def test_bins_are_right_closed(spark):
    frame = spark.createDataFrame(
        [(i, a, h, g) for i, (a, h, g) in enumerate([(5000.0, 6.0, 25.0), (5000.01, 6.5, 26.0), (100000.0, 12.0, 65.0), (100001.0, 19.0, 66.0)])],
        "row_idx long, total_claim_amount double, incident_hour_of_the_day double, age double",
    )
    assert rows(features.row_features(frame), "amount_category", "hour_category", "age_group") == [
        ("Very Low", "Night", "Young"), ("Low", "Morning", "Young Adult"), ("High", "Morning", "Senior"), ("Very High", "Evening", "Elderly"),
    ]


def test_validation_reasons(spark):
    frame = spark.createDataFrame(
        [(0, "a", "5", 1), (1, None, "5", 1), (2, "c", None, 1), (3, "d", "abc", 1), (4, "e", "-1", 1), (5, "f", "NaN", 1), (6, "", "5", 1), (7, "h", "5", None)],
        "row_idx long, claim_id string, total_claim_amount string, incident_hour_of_the_day int",
    )
    good, bad = cleaning.validate_claims(frame)
    assert [r[0] for r in rows(good, "row_idx")] == [0]
    assert rows(bad, "row_idx", "reject_reason") == [
        (1, cleaning.MISSING_FIELDS), (2, cleaning.MISSING_FIELDS), (3, cleaning.NOT_NUMERIC), (4, cleaning.NOT_POSITIVE),
        (5, cleaning.FILTERED_OUT), (6, cleaning.MISSING_FIELDS), (7, cleaning.MISSING_FIELDS),
    ]


def test_benford_score_of_one_claim(spark):
    frame = spark.createDataFrame([(0, 200.0)], "row_idx long, total_claim_amount double")
    score = features.engineer_features(frame).first()["benford_anomaly_score"]
    assert score == pytest.approx(0.301 + (1 - 0.176) + 0.125 + 0.097 + 0.079 + 0.067 + 0.058 + 0.051 + 0.046)


def test_empty_frame(spark):
    frame = spark.createDataFrame([], "row_idx long, claim_id string, total_claim_amount double")
    assert score_claims(frame).count() == 0
    assert quality_score(frame).first()["quality_score"] is None
    assert profile_upload(frame).first()["missing_pct"] == 0


def test_final_score_resolution(spark):
    frame = spark.createDataFrame(
        [(0, "12.5", 1.0, 2.0), (1, "x", math.nan, 140.0), (2, None, -4.0, 1.0), (3, None, None, math.inf)],
        "row_idx long, final_risk_score string, risk_score double, combined_score double",
    )
    assert [r[0] for r in rows(frame.withColumn("s", resolve_final_score(frame)), "s")] == [12.5, 100.0, 0.0, None]


def test_hours_and_labels(spark):
    frame = spark.createDataFrame([(0, "0"), (1, "14"), (2, "30"), (3, "x"), (4, None), (5, "12"), (6, "14.0")], "row_idx long, h string")
    assert [r[0] for r in rows(frame.withColumn("t", views.format_incident_hour(frame, "h")), "t")] == ["12 AM", "2 PM", "11 PM", "", "", "12 PM", ""]
    labels = spark.createDataFrame([(0, " Yes "), (1, "T"), (2, "0"), (3, "maybe"), (4, None)], "row_idx long, v string")
    assert [r[0] for r in rows(labels.withColumn("y", views.normalize_fraud_label(F.col("v"))), "y")] == ["Y", "Y", "N", None, None]


def test_single_claim_equals_batch_of_one(spark):
    claim = {
        "claim_id": "S1", "total_claim_amount": 260000, "incident_hour_of_the_day": 2, "age": 22, "witnesses": 0,
        "incident_type": "Vehicle Theft", "incident_severity": "Total Loss", "police_report_available": "NO",
    }
    single = score_claim(spark, claim).first()
    batch = score_claims(spark.createDataFrame([{**claim, "row_idx": 0}])).first()
    assert single["risk_score"] == batch["risk_score"] == 100.0
    assert single["explanation"] == batch["explanation"]


def test_labels_never_fan_out(spark):
    results = spark.createDataFrame([("a",), ("b",), ("c",)], "claim_id string")
    labels = spark.createDataFrame([(0, " a", "maybe"), (1, "a", "Y"), (2, "b", "no")], "row_idx long, claim_id string, fraud_reported string")
    found = {r["claim_id"]: r["actual_fraud"] for r in join_labels(results, labels).collect()}
    assert found == {"a": None, "b": "N", "c": None}


def test_export_join_keeps_unmatched_rows(spark):
    upload = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0)], "row_idx long, claim_id string, amount double")
    results = spark.createDataFrame([(0, "b", 9.0), (1, "z", 8.0)], "row_idx long, claim_id string, amount double")
    found = {r["claim_id"]: (r["amount"], r["result_amount"]) for r in export_join(upload, results).collect()}
    assert found == {"a": (1.0, None), "b": (2.0, 9.0), "z": (None, 8.0)}
    twice = spark.createDataFrame([(0, "b", 1.0), (1, "b", 2.0)], upload.schema)
    repeated = {r["claim_id"]: (r["amount"], r["result_amount"]) for r in export_join(twice, results).collect()}
    assert repeated == {"b": (1.0, 9.0), "b_dup_1": (2.0, None), "z": (None, 8.0)}
    literal = export_join(twice, results, literal_ids=True)
    assert {r["claim_id"] for r in literal.collect()} == {"b_0", "b_1", "b", "z"}


def test_repeat_union(spark):
    frame = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx long, v string")
    assert rows(repeat_union(frame, 3, 5), "row_idx", "v") == [(0, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "a")]


def test_profile_counts_missing_and_outliers(spark):
    frame = spark.createDataFrame([(float(i), None if i % 2 else "t") for i in range(19)] + [(1000.0, "t")], "x double, t string")
    assert {r[0]: r[1] for r in missing_pct(frame).collect()} == {"x": 0.0, "t": 45.0}
    assert outlier_pct(frame).collect()[0]["outlier_pct"] == pytest.approx(5.0)
    assert outlier_pct(frame, approx=True).collect()[0]["outlier_pct"] == pytest.approx(5.0)
