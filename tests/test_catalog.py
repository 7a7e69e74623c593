"""Registered queries against the oracle, and properties of their plans."""

import os

import pytest
from compare import difference, oracle_connection
from conftest import SMALL, plan_text

from claimsieve.catalog import ORACLES, QUERIES
from claimsieve.fixtures import claims_raw, table
from claimsieve.operators import policy
from claimsieve.operators.cleaning import clean_claims
from claimsieve.plans.pipeline import score_claims

#: CLAIMSIEVE_ALL_QUERIES=1 checks every query; the default is one of each kind.
CHOSEN = (
    list(ORACLES)
    if os.environ.get("CLAIMSIEVE_ALL_QUERIES")
    else [
        "map_columns", "prepare_claims", "dictionary_features", "score_claims", "join_predictions", "add_explanations", "explain_rule",
        "summary_insights", "filter_by_band", "outlier_pct", "fraud_patterns", "session_statistics", "export_join", "join_labels",
        "normality_report", "qq_points", "read_claims_csv", "pseudo_labels", "stratified_folds", "knn_join_partitioned", "tomek_links",
        "knn_probability", "roc_auc", "average_precision", "contribution_text",
    ]
)


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_oracle(spark, connection, name):
    assert difference(QUERIES[name](spark, SMALL), connection, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_scoring_plan_stays_native(spark):
    text = plan_text(score_claims(claims_raw(spark, SMALL)))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "SinglePartition, ENSURE"):
        physical = text.split("== Physical Plan ==")[1]
        assert word not in physical.replace("Subquery", "") or word.startswith("SinglePartition")
    # The only wide shuffle is the look-up of repeated ids; no window over the batch.
    assert "Window" not in text.split("== Physical Plan ==")[1]


def test_policy_window_runs_on_days_not_claims(spark):
    plan = plan_text(policy.policy_history(clean_claims(claims_raw(spark, SMALL)))).split("== Physical Plan ==")[1]
    window = plan.index("Window")
    assert "HashAggregate" in plan[window:]


def test_scan_reads_needed_columns_only(spark):
    from claimsieve.operators.profile import outlier_pct

    plan = plan_text(outlier_pct(table(spark, SMALL, "lineitem"), ["l_extendedprice"]))
    assert "ReadSchema: struct<l_extendedprice:double>" in plan


def test_quantiles_shuffle_only_the_ranges_they_need(spark):
    from claimsieve.operators.profile import outlier_pct
    from claimsieve.plans.ordered import exact_quantiles

    lines = table(spark, SMALL, "lineitem")
    # The outlier count itself has no shuffle but the aggregate's, and no value is grouped over the whole table.
    plan = plan_text(outlier_pct(lines, ["l_extendedprice"], approx=True)).split("== Physical Plan ==")[1]
    assert "hashpartitioning" not in plan
    found = exact_quantiles(lines, ["l_extendedprice"], {"q1": 0.25}).first()
    expected = spark.sql("SELECT percentile(l_extendedprice, 0.25) AS q FROM {t}", t=lines).first()[0]
    assert found["q1"] == pytest.approx(expected)


def test_filters_reach_the_scan(spark):
    frame = clean_claims(table(spark, SMALL, "lineitem").selectExpr("l_extendedprice AS total_claim_amount", "l_orderkey AS row_idx"))
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,7)]" in plan_text(frame.where("row_idx = 7"))
