"""Global ranks, quantiles, splits and normality tests against independent values."""

import numpy as np
import pytest
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import functions as F

from claimsieve.operators.policy import percentile_rank, policy_history
from claimsieve.plans.ordered import exact_quantiles, value_distribution, with_running_totals
from claimsieve.plans.strata import assign_blocks
from claimsieve.stats import normality

WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
RATES = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66]


def frame_of(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "row_idx long, x double")


def hot_values(n=3000):
    rng = np.random.default_rng(7)
    values = np.round(rng.lognormal(3, 1, n), 1)
    values[: n // 3] = 42.0
    return values


@pytest.mark.parametrize("buckets", [2, 8, 50])
def test_quantiles_and_ranks_with_a_hot_value(spark, buckets):
    values = hot_values()
    frame = frame_of(spark, values).repartition(5)
    ranked = with_running_totals(value_distribution(frame, ["x"], buckets=buckets)).orderBy("value").collect()
    unique, counts = np.unique(values, return_counts=True)
    assert [r["value"] for r in ranked] == list(unique)
    assert [r["n_upto"] for r in ranked] == list(np.cumsum(counts))
    found = exact_quantiles(frame, ["x"], {"a": 0.25, "b": 0.9, "c": 0.5}).first()
    assert [found["a"], found["b"], found["c"]] == pytest.approx(list(np.quantile(values, [0.25, 0.9, 0.5])))


def test_percentile_rank_averages_ties(spark):
    frame = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 5.0), (3, 9.0)], "row_idx long, total_claim_amount double")
    found = {r["row_idx"]: r["claim_percentile_rank"] for r in percentile_rank(frame).collect()}
    assert found == {0: 0.25, 1: 0.625, 2: 0.625, 3: 1.0}


@pytest.mark.parametrize("values, w, p", [(WEIGHTS, 0.7888147830963135, 0.006703814061898823), (RATES, 0.90047299861907959, 0.042089745402336121)])
def test_shapiro_published_examples(spark, values, w, p):
    found = normality.shapiro_wilk(frame_of(spark, values), ["x"]).first()
    assert found["shapiro_stat"] == pytest.approx(w, abs=2e-6)
    assert found["shapiro_pvalue"] == pytest.approx(p, abs=2e-5)


def test_shapiro_of_three_and_five(spark):
    assert normality.shapiro_wilk(frame_of(spark, [1, 2, 3]), ["x"]).first()["shapiro_stat"] == pytest.approx(1.0, abs=1e-9)
    five = normality.shapiro_wilk(frame_of(spark, [1, 2, 3, 4, 5]), ["x"]).first()
    assert five["shapiro_stat"] == pytest.approx(0.986762, abs=1e-5)


def test_shapiro_with_ties_over_chunks(spark, monkeypatch):
    values = hot_values(600)
    whole = normality.shapiro_wilk(frame_of(spark, values), ["x"]).first()
    monkeypatch.setattr(normality, "RANK_CHUNK", 16)
    chunked = normality.shapiro_wilk(frame_of(spark, values), ["x"]).first()
    assert chunked["shapiro_stat"] == pytest.approx(whole["shapiro_stat"], abs=1e-12)


def test_ks_against_spark_ml(spark):
    values = np.random.default_rng(3).normal(10, 2, 400)
    frame = frame_of(spark, values)
    ours = normality.ks_normal(frame, ["x"]).first()
    theirs = KolmogorovSmirnovTest.test(frame, "x", "norm", float(values.mean()), float(values.std(ddof=1))).first()
    assert ours["ks_stat"] == pytest.approx(theirs["statistic"], abs=1e-9)
    assert ours["ks_pvalue"] == pytest.approx(theirs["pValue"], abs=2e-3)


def test_report_recommendations(spark):
    rng = np.random.default_rng(5)
    normal, skewed = rng.normal(0, 1, 300), rng.exponential(1, 300)
    frame = spark.createDataFrame([(float(a), float(b), 3.0, float(i) if i < 2 else None) for i, (a, b) in enumerate(zip(normal, skewed))], "a double, b double, c double, d double")
    found = {r["column"]: r for r in normality.normality_report(frame, ["a", "b", "c", "d"]).collect()}
    assert found["a"]["recommendation"] == "use_zscore" and found["a"]["is_normal"]
    assert found["b"]["recommendation"] == "use_alternative_method"
    assert found["c"]["recommendation"] == "use_alternative_method" and found["c"]["shapiro_stat"] is None
    assert found["d"]["recommendation"] == "insufficient_data" and found["d"]["n"] == 2
    flagged = normality.outlier_flags(frame, "a")
    assert flagged.select("outlier_method").first()[0] == "zscore"


def test_iqr_needs_four_values(spark):
    assert normality.iqr_bounds(frame_of(spark, [1, 2, 3]), ["x"]).first()["iqr"] is None
    found = normality.iqr_bounds(frame_of(spark, [1, 2, 3, 4]), ["x"]).first()
    assert (found["q1"], found["q3"], found["lower_bound"]) == (1.75, 3.25, -0.5)


def test_qq_points_cover_every_rank(spark):
    found = normality.qq_points(frame_of(spark, [3, 1, 2, 2]), "x").orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2, 3, 4]
    assert found[0]["theoretical"] == pytest.approx(-2.3263478740408408, abs=1e-9)
    assert normality.qq_points(frame_of(spark, [3, 1]), "x").count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_blocks_are_exact_shares_in_hash_order(spark, partitions):
    import hashlib

    frame = spark.range(1000).select(F.col("id").alias("row_idx"), (F.col("id") % 10 == 0).cast("int").alias("label")).repartition(partitions)
    found = assign_blocks(frame, "label", "row_idx", [0.2, 0.5], "block").collect()
    for label in (0, 1):
        mine = sorted((r for r in found if r["label"] == label), key=lambda r: hashlib.md5(str(r["row_idx"]).encode()).hexdigest())
        n = len(mine)
        assert [r["block"] for r in mine] == [0] * int(0.2 * n) + [1] * (int(0.5 * n) - int(0.2 * n)) + [2] * (n - int(0.5 * n))


def test_policy_history_with_a_hot_policy(spark):
    import datetime as dt

    day = dt.date(2024, 1, 1)
    claims = [(i, "hot" if i % 3 == 0 else f"p{i % 4}", day + dt.timedelta(days=(i * 7) % 90)) for i in range(200)]
    claims.append((200, None, day))
    frame = spark.createDataFrame(claims, "row_idx long, policy_number string, incident_date date")
    found = {r["row_idx"]: r for r in policy_history(frame).collect()}
    for idx, policy, when in claims:
        mine = sorted((d, i) for i, p, d in claims if p == policy)
        position = mine.index((when, idx))
        assert found[idx]["days_since_last_claim"] == (-1 if position == 0 else (when - mine[position - 1][0]).days)
        assert found[idx]["claims_last_30d"] == sum(0 <= (when - d).days <= 30 for d, _ in mine)
