"""Query registry, shared frames and the shared parts of the oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schema as S
from ..fixtures import claims_raw, claims_sql, timestamp_by_quarter
from ..operators.rules import apply_rules
from ..operators.runs import run_records
from ..plans.pipeline import prepare_claims, score_claims

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(build(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: 64-bit integers, doubles to 6 places, arrays of text joined."""
    columns = []
    for f in df.schema:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            columns.append(f"CAST({c} AS BIGINT) AS {c}")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            columns.append(f"round({c}, 6) AS {c}")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            columns.append(f"array_join({c}, ' | ') AS {c}")
        else:
            columns.append(c)
    return df.selectExpr(*columns)


# --- frames ------------------------------------------------------------------
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_claims(claims_raw(spark, sf_dir))


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(prepared(spark, sf_dir))


#: A stand-in for a model probability, computed from the row, so fusion can be checked in SQL.
PROBABILITY = "CASE WHEN row_idx % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(row_idx * 37 % 101 AS DOUBLE) / 101 END"


def with_probability(df: DataFrame, name: str = "ml_fraud_prob") -> DataFrame:
    return df.selectExpr("*", f"{PROBABILITY} AS {name}")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_claims(claims_raw(spark, sf_dir))


def scored_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_claims(claims_raw(spark, sf_dir), predict=with_probability)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored claims with the run they belong to: a quarter of a day."""
    return timestamp_by_quarter(scored(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = run_records(results(spark, sf_dir), ["run_id", "timestamp"])
    return records.selectExpr("*", "claims_count / 1000 + hour(timestamp) / 8 AS runtime")


# --- oracle parts ------------------------------------------------------------
def case_bins(value: str, bins: list, low: float) -> str:
    parts = [f"WHEN {value} <= {low} THEN NULL"]
    parts += [f"WHEN {value} <= {u} THEN '{n}'" if u is not None else f"ELSE '{n}'" for u, n in bins]
    return f"CASE {' '.join(parts)} END"


DIGIT = "CAST(substr(CAST(CAST(floor(total_claim_amount) AS BIGINT) AS VARCHAR), 1, 1) AS BIGINT)"

RAW = f"claims_raw AS ({claims_sql()})"

CLEANED = f"""{RAW},
deduped AS (
  SELECT * REPLACE (CASE WHEN row_number() OVER (PARTITION BY claim_id ORDER BY row_idx) > 1
    THEN coalesce(claim_id, 'nan') || '_dup_' || row_idx ELSE claim_id END AS claim_id)
  FROM claims_raw),
cleaned AS (
  SELECT * REPLACE (
    CAST(least(greatest(coalesce(incident_hour_of_the_day, 12), 0), 23) AS DOUBLE) AS incident_hour_of_the_day,
    CAST(least(greatest(coalesce(age, 35), 18), 100) AS DOUBLE) AS age,
    CAST(least(greatest(coalesce(witnesses, 1), 0), 10) AS DOUBLE) AS witnesses)
  FROM deduped WHERE total_claim_amount > 0)"""

EXPECTED = ", ".join(f"({d}, CAST({e} AS DOUBLE))" for d, e in S.BENFORD_SHARES.items())

PREPARED = f"""{CLEANED},
featured AS (
  SELECT *, ln(1 + total_claim_amount) AS log_claim_amount,
    {case_bins('total_claim_amount', S.AMOUNT_BINS, 0)} AS amount_category,
    CAST(total_claim_amount % 1000 = 0 AS BIGINT) AS is_round_amount,
    {case_bins('incident_hour_of_the_day', S.HOUR_BINS, -1)} AS hour_category,
    CAST(incident_hour_of_the_day NOT BETWEEN 5.5 AND 21.5 AS BIGINT) AS unusual_hour,
    {case_bins('age', S.AGE_BINS, 0)} AS age_group,
    CAST(age < 25 AS BIGINT) AS young_driver,
    CAST(CASE incident_severity WHEN 'Total Loss' THEN 3 WHEN 'Major Damage' THEN 2 ELSE 1 END AS DOUBLE) AS severity_numeric,
    CAST(incident_state IN ('NY', 'CA', 'FL', 'TX') AS BIGINT) AS high_risk_state,
    {DIGIT} AS first_digit,
    total_claim_amount / age AS amount_per_age,
    CAST(total_claim_amount > 50000 AND witnesses = 0 AS BIGINT) AS high_amount_no_witnesses
  FROM cleaned),
digit_table AS (
  SELECT e.digit, e.expected, coalesce(a.share, 0) AS actual
  FROM (VALUES {EXPECTED}) e(digit, expected)
  LEFT JOIN (SELECT first_digit, count(*) / sum(count(*)) OVER () AS share FROM featured GROUP BY first_digit) a
    ON a.first_digit = e.digit),
prepared AS (
  SELECT *, (SELECT sum(abs(expected - actual)) FROM digit_table) AS benford_anomaly_score FROM featured)"""

RULE_SQL = {
    "z_score_outlier": "total_claim_amount > 300000",
    "benford_violation": "first_digit >= 8",
    "very_suspicious_hour": "incident_hour_of_the_day IN (1, 2, 3, 4)",
    "unusual_hour": "incident_hour_of_the_day IN (0, 5, 22, 23)",
    "round_amount": "total_claim_amount % 50000 = 0 OR (total_claim_amount >= 100000 AND total_claim_amount % 10000 = 0)",
    "extreme_amount": "total_claim_amount >= 250000",
    "high_amount": "total_claim_amount >= 150000 AND total_claim_amount < 250000",
    "young_high_claim": "age < 25 AND total_claim_amount >= 100000",
    "no_witnesses_high_claim": "witnesses = 0 AND total_claim_amount >= 150000",
    "no_police_report": "coalesce(police_report_available IN ('NO', 'UNKNOWN', 'N'), false)",
    "theft_no_police": "coalesce(police_report_available IN ('NO', 'UNKNOWN', 'N') AND lower(incident_type) LIKE '%theft%', false)",
    "total_loss_suspicious": "coalesce(incident_severity IN ('Total Loss', 'Major Damage'), false)",
    "severity_mismatch": "coalesce(incident_severity IN ('Total Loss', 'Major Damage') AND witnesses = 0, false)",
}
POINTS = {
    "z_score_outlier": 18, "benford_violation": 12, "very_suspicious_hour": 25, "unusual_hour": 15, "round_amount": 12,
    "extreme_amount": 30, "high_amount": 20, "young_high_claim": 28, "no_witnesses_high_claim": 22,
    "no_police_report": 25, "theft_no_police": 35, "total_loss_suspicious": 25, "severity_mismatch": 20,
}

RULED = f"""{PREPARED},
flagged AS (SELECT *, {', '.join(f'({c}) AS r_{n}' for n, c in RULE_SQL.items())} FROM prepared),
weighed AS (
  SELECT *,
    {' + '.join(f'CAST(r_{n} AS INTEGER) * {w}' for n, w in POINTS.items())} AS points,
    CASE WHEN r_theft_no_police AND r_no_witnesses_high_claim THEN CAST(1.5 AS DOUBLE)
         WHEN (r_young_high_claim AND r_no_witnesses_high_claim) OR (r_no_police_report AND r_total_loss_suspicious) THEN 1.4
         WHEN r_extreme_amount AND r_no_police_report THEN 1.35
         WHEN (r_young_high_claim AND r_unusual_hour) OR (r_very_suspicious_hour AND r_extreme_amount) THEN 1.3
         ELSE 1 END AS combo_multiplier,
    concat_ws(', ', {', '.join(f"CASE WHEN r_{n} THEN '{n}' END" for n in RULE_SQL)}) AS triggered_rules
  FROM flagged),
ruled AS (
  SELECT *, least(points * combo_multiplier, CAST(100 AS DOUBLE)) AS risk_score,
    CASE WHEN triggered_rules = '' THEN [] ELSE string_split(triggered_rules, ', ') END AS indicators FROM weighed)"""

SCORED = f"""{RULED},
scored AS (
  SELECT *, risk_score AS final_risk_score,
    CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 30 THEN 'Medium' ELSE 'Low' END AS risk_level,
    CASE WHEN risk_score >= 70 THEN 'Fraud' ELSE 'Legitimate' END AS fraud_prediction
  FROM ruled)"""

RESULTS = f"""{SCORED},
results AS (
  SELECT *, strftime(incident_ts, '%Y-%m-%d') || '_' || (hour(incident_ts) // 6) AS run_id,
    date_trunc('day', incident_ts) + to_hours(CAST(hour(incident_ts) // 6 * 6 AS BIGINT)) AS timestamp
  FROM scored)"""

RUNS = f"""{RESULTS},
runs AS (
  SELECT run_id, timestamp, count(*) AS claims_count,
    count(*) FILTER (risk_level = 'High') AS high_risk_count,
    count(*) FILTER (risk_level = 'Medium') AS medium_risk_count,
    count(*) FILTER (risk_level = 'Low') AS low_risk_count,
    avg(final_risk_score) AS avg_risk_score,
    count(*) FILTER (fraud_prediction = 'Fraud') AS fraud_predictions,
    count(*) / 1000 + hour(timestamp) / 8 AS runtime
  FROM results GROUP BY run_id, timestamp)"""


def oracle(parts: str, select: str) -> str:
    return f"WITH {parts}\n{select}"
