"""Queries of explanations, profiles, run history, joins, statistics and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import claims_raw, table, timestamp_by_quarter
from ..functions.normal import normal_cdf, normal_ppf
from ..functions.text import quoted
from ..operators import cleaning, explain, joins, profile, views
from ..operators import runs as history
from ..session import scratch_path, stored
from ..sources import files
from ..sources.run_store import RunStore
from ..stats import normality
from .base import (
    CLEANED,
    PREPARED,
    PROBABILITY,
    RAW,
    RESULTS,
    RULED,
    RUNS,
    SCORED,
    oracle,
    prepared,
    query,
    results,
    ruled,
    runs,
    scored,
    scored_with_model,
)

# --- explanations ------------------------------------------------------------
PICK = "(instr('0123456789abcdef', substr(md5(claim_id), 1, 1)) - 1)"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _variant(options: list[str]) -> str:
    return f"CASE {PICK} % {len(options)} " + " ".join(f"WHEN {i} THEN {_sql(o)}" for i, o in enumerate(options)) + " END"


MODELLED = f"""{RULED},
modelled AS (
  SELECT * EXCLUDE (risk_score), {PROBABILITY} AS p, len(indicators) AS fired,
    CASE WHEN {PROBABILITY} IS NULL THEN risk_score
         ELSE CAST(0.6 AS DOUBLE) * risk_score + CAST(0.4 AS DOUBLE) * {PROBABILITY} * 100 END AS score
  FROM ruled),
worded AS (
  SELECT *,
    CASE WHEN fired = 0 THEN {_sql(explain.NO_RULE_REASON)} ELSE 'Analysis detected: ' || indicators[1] END AS reason_1,
    CASE WHEN fired = 0 THEN {_sql(explain.NO_RULE_SECOND)} WHEN fired = 1 THEN {_sql(explain.ONE_RULE_SECOND)}
         ELSE 'Secondary concern: ' || indicators[2] END AS reason_2,
    concat_ws(' ',
      CASE WHEN score >= 70 THEN {_variant(explain.BAND_TEXTS['high_risk'])}
           WHEN score >= 30 THEN {_variant(explain.BAND_TEXTS['medium_risk'])}
           ELSE {_variant(explain.BAND_TEXTS['low_risk'])} END,
      'The risk score of ' || printf('%.2f', round_even(score * 100, 0) / 100) ||
      CASE WHEN score >= 80 THEN '/100 indicates very high fraud likelihood.'
           WHEN score >= 60 THEN '/100 suggests elevated fraud risk.'
           WHEN score >= 30 THEN '/100 indicates moderate concern.'
           ELSE '/100 is within normal ranges.' END,
      CASE WHEN fired = 1 THEN 'One fraud indicator was detected during analysis.'
           WHEN fired > 1 THEN fired || ' fraud indicators were detected during analysis.' END,
      CASE WHEN p > 0.7 THEN 'Machine learning models strongly suggest fraudulent activity.'
           WHEN p > 0.4 THEN 'Machine learning models indicate some concern.'
           WHEN p > 0 THEN 'Machine learning models support legitimate classification.' END) AS explanation
  FROM modelled)"""


@query("parse_rules", oracle(RULED, "SELECT row_idx, array_to_string(indicators, ' | ') AS rules FROM ruled"))
def parse_rules(spark, sf_dir):
    # Half of the rows carry their rules only as text with blanks and empty items.
    frame = ruled(spark, sf_dir).selectExpr(
        "row_idx",
        "CASE WHEN row_idx % 2 = 0 THEN top_indicators ELSE array(' ', '') END AS top_indicators",
        "concat(' , ', replace(triggered_rules, ', ', ' ,  '), ',') AS triggered_rules",
    )
    return frame.select("row_idx", explain.parse_rules(frame).alias("rules"))


@query("reason_1", oracle(MODELLED, "SELECT row_idx, reason_1 FROM worded"))
def reason_1(spark, sf_dir):
    return ruled(spark, sf_dir).select("row_idx", explain.reason_1(F.col("top_indicators"), F.col("claim_id")).alias("reason_1"))


@query("reason_2", oracle(MODELLED, "SELECT row_idx, reason_2 FROM worded"))
def reason_2(spark, sf_dir):
    return ruled(spark, sf_dir).select("row_idx", explain.reason_2(F.col("top_indicators"), F.col("claim_id")).alias("reason_2"))


@query(
    "explain_rule",
    oracle(
        RULED,
        "SELECT row_idx, rule, CASE rule "
        + " ".join(f"WHEN '{r}' THEN {_variant(explain.RULE_TEXTS[t])}" for r, t in explain.RULE_TITLES.items())
        + " ELSE 'Rule: ' || rule || ' - No detailed explanation available' END AS rule_text "
        "FROM (SELECT row_idx, claim_id, unnest(indicators) AS rule FROM ruled)",
    ),
)
def explain_rule(spark, sf_dir):
    fired = ruled(spark, sf_dir).select("row_idx", "claim_id", F.explode("top_indicators").alias("rule"))
    return fired.select("row_idx", "rule", explain.explain_rule(F.col("rule"), F.col("claim_id"), friendly=True).alias("rule_text"))


@query("explanation", oracle(MODELLED, "SELECT row_idx, explanation FROM worded"))
def explanation(spark, sf_dir):
    return scored_with_model(spark, sf_dir).select("row_idx", "explanation")


@query("add_explanations", oracle(MODELLED, "SELECT row_idx, claim_id, reason_1, reason_2, triggered_rules, explanation FROM worded"))
def add_explanations(spark, sf_dir):
    return scored_with_model(spark, sf_dir).select("row_idx", "claim_id", "reason_1", "reason_2", "triggered_rules", "explanation")


def _share(level: str) -> str:
    count = f"count(*) FILTER (risk_level = '{level}')"
    return f"{count} || ' claims (' || printf('%.1f', round_even({count} / count(*) * 100 * 10, 0) / 10) || '%) '"


@query(
    "summary_insights",
    oracle(
        SCORED,
        f"""SELECT concat_ws(' ',
  'Analyzed ' || count(*) || ' claims with an average risk score of ' || printf('%.1f', round_even(avg(final_risk_score) * 10, 0) / 10) || '/100.',
  {_share('High')} || 'require immediate investigation.',
  {_share('Medium')} || 'need additional verification.',
  {_share('Low')} || 'can proceed with standard processing.',
  'Most common fraud indicators: ' || (SELECT string_agg(rule, ', ' ORDER BY n DESC, rule) FROM (
     SELECT rule, count(*) AS n FROM (SELECT unnest(indicators) AS rule FROM ruled) GROUP BY rule ORDER BY n DESC, rule LIMIT 2)) || '.') AS insights
FROM scored""",
    ),
)
def summary_insights(spark, sf_dir):
    return explain.summary_insights(scored(spark, sf_dir))


# --- profile -----------------------------------------------------------------
UPLOAD = [
    "row_idx", "claim_id", "policy_number", "total_claim_amount", "incident_hour_of_the_day", "age", "incident_state", "incident_severity",
    "incident_type", "witnesses", "police_report_available", "authorities_contacted", "property_damage", "policy_bind_year",
    "injury_claim", "property_claim", "vehicle_claim", "fraud_reported",
]
UPLOAD_NUMERIC = [
    "row_idx", "total_claim_amount", "incident_hour_of_the_day", "age", "witnesses", "policy_bind_year", "injury_claim", "property_claim", "vehicle_claim",
]


def _upload(spark, sf_dir):
    return claims_raw(spark, sf_dir).select(*UPLOAD)


MISSING = " + ".join(f"count(*) - count({c})" for c in UPLOAD)


@query(
    "profile_upload",
    oracle(
        RAW,
        f"""SELECT count(*) AS total_rows, CAST({len(UPLOAD)} AS BIGINT) AS total_columns, CAST({len(UPLOAD_NUMERIC)} AS BIGINT) AS numeric_columns,
  CAST({len(UPLOAD) - len(UPLOAD_NUMERIC)} AS BIGINT) AS text_columns, round(({MISSING}) / (count(*) * {len(UPLOAD)}) * 100, 6) AS missing_pct,
  round(100 - ({MISSING}) / (count(*) * {len(UPLOAD)}) * 100, 6) AS complete_pct FROM claims_raw""",
    ),
)
def profile_upload(spark, sf_dir):
    return profile.profile_upload(_upload(spark, sf_dir))


MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (count(*) - count({c})) / count(*) * 100 AS missing_pct FROM claims_raw" for c in UPLOAD
)
OUTLIER_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*) * 100 AS outlier_pct
FROM claims_raw CROSS JOIN (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM claims_raw)"""
    for c in UPLOAD_NUMERIC
)


@query("missing_pct", oracle(RAW, f'SELECT "column", round(missing_pct, 6) AS missing_pct FROM ({MISSING_SQL})'))
def missing_pct(spark, sf_dir):
    return profile.missing_pct(_upload(spark, sf_dir))


@query("outlier_pct", oracle(RAW, f'SELECT "column", round(outlier_pct, 6) AS outlier_pct FROM ({OUTLIER_SQL})'))
def outlier_pct(spark, sf_dir):
    return profile.outlier_pct(_upload(spark, sf_dir))


@query(
    "quality_score",
    oracle(
        RAW,
        f"""SELECT round(m, 6) AS avg_missing_pct, round(o, 6) AS avg_outlier_pct, round(greatest(0, 100 - m - o * 0.5), 6) AS quality_score
FROM (SELECT avg(missing_pct) AS m FROM ({MISSING_SQL})) CROSS JOIN (SELECT avg(outlier_pct) AS o FROM ({OUTLIER_SQL}))""",
    ),
)
def quality_score(spark, sf_dir):
    return profile.quality_score(_upload(spark, sf_dir))


@query(
    "data_types",
    oracle(
        RAW,
        f"""SELECT m."column", round(missing_pct, 6) AS missing_pct, round(outlier_pct, 6) AS outlier_pct,
  CASE t.data_type WHEN 'VARCHAR' THEN 'string' ELSE lower(t.data_type) END AS data_type
FROM ({MISSING_SQL}) m LEFT JOIN ({OUTLIER_SQL}) o ON m."column" = o."column"
JOIN (SELECT unnest([{', '.join(f"'{c}'" for c in UPLOAD)}]) AS "column", unnest([{', '.join(f'typeof(any_value({c}))' for c in UPLOAD)}]) AS data_type FROM claims_raw) t ON t."column" = m."column"
""",
    ),
)
def data_types(spark, sf_dir):
    # The types next to the measured shares, so the query works on the table itself.
    return profile.data_quality(_upload(spark, sf_dir))


LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "lineitem_quality",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*) * 100, 6) AS outlier_pct
FROM lineitem CROSS JOIN (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lineitem)"""
        for c in LINEITEM_NUMERIC
    ),
)
def lineitem_quality(spark, sf_dir):
    return profile.outlier_pct(table(spark, sf_dir, "lineitem"), LINEITEM_NUMERIC)


# --- dashboards and run history ----------------------------------------------
@query("risk_distribution", oracle(SCORED, "SELECT risk_level, count(*) AS n FROM scored GROUP BY risk_level"))
def risk_distribution(spark, sf_dir):
    return history.risk_distribution(scored(spark, sf_dir))


RULE_COUNTS = "SELECT rule, count(*) AS n FROM (SELECT unnest(indicators) AS rule FROM ruled) GROUP BY rule ORDER BY n DESC, rule"


@query("top_rules", oracle(RULED, f"{RULE_COUNTS} LIMIT 5"))
def top_rules(spark, sf_dir):
    return history.top_rules(ruled(spark, sf_dir), 5)


@query("daily_claim_counts", oracle(RESULTS, "SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM results GROUP BY 1"))
def daily_claim_counts(spark, sf_dir):
    return history.daily_claim_counts(results(spark, sf_dir))


@query(
    "dashboard_kpis",
    oracle(
        SCORED,
        """SELECT count(*) AS total_analyzed, count(*) FILTER (risk_level = 'High') AS flagged_count, round(avg(final_risk_score), 6) AS avg_risk_score,
  count(*) FILTER (risk_level = 'High') AS high_risk_count, round(count(*) FILTER (risk_level = 'High') / count(*) * 100, 6) AS fraud_rate FROM scored""",
    ),
)
def dashboard_kpis(spark, sf_dir):
    return history.dashboard_kpis(scored(spark, sf_dir))


STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp"
COUNTS = "claims_count, high_risk_count, medium_risk_count, low_risk_count, round(avg_risk_score, 6) AS avg_risk_score, fraud_predictions"


def _stamped(df):
    return df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("run_records", oracle(RUNS, f"SELECT run_id, {STAMP}, {COUNTS}, round(runtime, 6) AS runtime FROM runs"))
def run_records(spark, sf_dir):
    return _stamped(runs(spark, sf_dir))


@query("recent_runs", oracle(RUNS, f"SELECT run_id, {STAMP}, {COUNTS}, round(runtime, 6) AS runtime, round(high_risk_count / claims_count * 100, 6) AS fraud_rate FROM runs ORDER BY runs.timestamp DESC LIMIT 10"))
def recent_runs(spark, sf_dir):
    return _stamped(history.recent_runs(runs(spark, sf_dir), 10))


@query("retain_last_runs", oracle(RUNS, f"SELECT run_id, {STAMP}, {COUNTS}, round(runtime, 6) AS runtime FROM runs ORDER BY runs.timestamp DESC LIMIT 50"))
def retain_last_runs(spark, sf_dir):
    return _stamped(history.retain_last_runs(runs(spark, sf_dir)))


@query(
    "run_time_series",
    oracle(RUNS, f"SELECT {STAMP}, claims_count, high_risk_count, round(avg_risk_score, 6) AS avg_risk_score, round(runtime, 6) AS runtime, fraud_predictions FROM runs"),
)
def run_time_series(spark, sf_dir):
    return _stamped(history.run_time_series(runs(spark, sf_dir)))


@query("total_claims", oracle(RUNS, "SELECT CAST(sum(claims_count) AS BIGINT) AS total_claims FROM runs"))
def total_claims(spark, sf_dir):
    return history.total_claims(runs(spark, sf_dir))


@query("high_risk_pct", oracle(RUNS, "SELECT round(sum(high_risk_count) / sum(claims_count) * 100, 6) AS high_risk_pct FROM runs"))
def high_risk_pct(spark, sf_dir):
    return history.high_risk_pct(runs(spark, sf_dir))


@query("avg_runtime", oracle(RUNS, "SELECT round(avg(runtime), 6) AS avg_runtime FROM runs"))
def avg_runtime(spark, sf_dir):
    return history.avg_runtime(runs(spark, sf_dir))


NOW = "2024-02-01 00:00:00"


@query(
    "session_statistics",
    oracle(
        RUNS,
        f"""SELECT count(*) AS total_analyses, CAST(sum(claims_count) AS BIGINT) AS total_claims, round(sum(claims_count) / count(*), 6) AS avg_claims_per_analysis,
  round(sum(runtime), 6) AS total_runtime, round(avg(runtime), 6) AS avg_runtime, round(sum(high_risk_count) / sum(claims_count) * 100, 6) AS high_risk_rate,
  round(sum(fraud_predictions) / sum(claims_count) * 100, 6) AS fraud_detection_rate,
  round(date_diff('second', min(timestamp), TIMESTAMP '{NOW}') / 3600, 6) AS session_duration FROM runs""",
    ),
)
def session_statistics(spark, sf_dir):
    return history.session_statistics(runs(spark, sf_dir), now=F.expr(f"timestamp '{NOW}'"))


@query(
    "kpi_status",
    oracle(
        RUNS,
        """SELECT run_id,
  CASE WHEN high_risk_count / claims_count > 0.15 THEN 'High Alert' WHEN high_risk_count / claims_count < 0.05 THEN 'Normal' ELSE 'Monitor' END AS risk_status,
  CASE WHEN runtime < 2 THEN 'Fast' WHEN runtime < 5 THEN 'Normal' ELSE 'Slow' END AS speed_status,
  CASE WHEN low_risk_count / claims_count > 0.85 THEN 'Excellent' WHEN low_risk_count / claims_count > 0.7 THEN 'Good' ELSE 'Training' END AS accuracy_status
FROM runs""",
    ),
)
def kpi_status(spark, sf_dir):
    share = F.col("low_risk_count") / F.col("claims_count")
    high = F.col("high_risk_count") / F.col("claims_count") * 100
    return runs(spark, sf_dir).select("run_id", *history.kpi_status(high, F.col("runtime"), share))


@query(
    "performance_metrics",
    oracle(
        RUNS,
        """SELECT round(avg(runtime), 6) AS avg_runtime, round(min(runtime), 6) AS min_runtime, round(max(runtime), 6) AS max_runtime,
  round(stddev_pop(runtime), 6) AS std_runtime, round(avg(claims_count), 6) AS avg_claims_per_batch, CAST(sum(claims_count) AS BIGINT) AS total_unique_claims,
  (SELECT round(avg(final_risk_score), 6) FROM results) AS avg_risk_score_overall, (SELECT round(stddev_pop(final_risk_score), 6) FROM results) AS risk_score_std
FROM runs""",
    ),
)
def performance_metrics(spark, sf_dir):
    return history.performance_metrics(runs(spark, sf_dir), results(spark, sf_dir))


PATTERN_QUANTILES = " UNION ALL ".join(
    f"SELECT 'amount_quartiles', 'q{q}', quantile_cont(total_claim_amount, {q / 100}) FROM scored" for q in (25, 50, 75, 95)
)


@query(
    "fraud_patterns",
    oracle(
        SCORED,
        f"""SELECT pattern, item, round(CAST(value AS DOUBLE), 6) AS value FROM (
SELECT 'most_common_rules' AS pattern, rule AS item, CAST(n AS DOUBLE) AS value FROM ({RULE_COUNTS} LIMIT 10)
UNION ALL SELECT 'risk_distribution', risk_level, count(*) FROM scored GROUP BY risk_level
UNION ALL SELECT * FROM (SELECT 'peak_fraud_hours', CAST(CAST(incident_hour_of_the_day AS BIGINT) AS VARCHAR), count(*) FROM scored
  GROUP BY incident_hour_of_the_day ORDER BY count(*) DESC, incident_hour_of_the_day LIMIT 5)
UNION ALL {PATTERN_QUANTILES})""",
    ),
)
def fraud_patterns(spark, sf_dir):
    return history.fraud_patterns(scored(spark, sf_dir))


# --- joins -------------------------------------------------------------------
LABELLED = f"""{SCORED},
first_labels AS (
  SELECT claim_id, CASE lower(trim(fraud_reported)) WHEN 'yes' THEN 'Y' WHEN '0' THEN 'N' WHEN 'n' THEN 'N' END AS actual_fraud
  FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY row_idx) AS rn FROM claims_raw) WHERE rn = 1),
labelled AS (SELECT s.row_idx, s.claim_id, CASE s.fraud_prediction WHEN 'Fraud' THEN 'Y' ELSE 'N' END AS fraud_prediction, l.actual_fraud
  FROM scored s LEFT JOIN first_labels l USING (claim_id))"""


def _labelled(spark, sf_dir):
    frame = scored(spark, sf_dir).select(
        "row_idx", "claim_id", F.when(F.col("fraud_prediction") == "Fraud", "Y").otherwise("N").alias("fraud_prediction")
    )
    return joins.join_labels(frame, claims_raw(spark, sf_dir))


@query("join_labels", oracle(LABELLED, "SELECT row_idx, claim_id, fraud_prediction, actual_fraud FROM labelled"))
def join_labels(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query(
    "label_accuracy",
    oracle(LABELLED, "SELECT count(*) AS n_labelled, round(avg(CAST(fraud_prediction = actual_fraud AS INTEGER)) * 100, 6) AS accuracy_pct FROM labelled WHERE actual_fraud IS NOT NULL"),
)
def label_accuracy(spark, sf_dir):
    return views.label_accuracy(_labelled(spark, sf_dir))


@query(
    "label_match",
    oracle(LABELLED, "SELECT row_idx, CASE WHEN actual_fraud IS NULL THEN NULL WHEN fraud_prediction = actual_fraud THEN 'Match' ELSE 'Mismatch' END AS label_match FROM labelled"),
)
def label_match(spark, sf_dir):
    return _labelled(spark, sf_dir).select("row_idx", views.label_match(F.col("fraud_prediction"), F.col("actual_fraud")).alias("label_match"))


@query(
    "export_join",
    oracle(
        SCORED,
        """SELECT coalesce(u.claim_id, s.claim_id) AS claim_id, u.row_idx, u.total_claim_amount, s.total_claim_amount AS result_total_claim_amount,
  round(s.final_risk_score, 6) AS final_risk_score, s.risk_level
FROM deduped u FULL OUTER JOIN scored s ON u.claim_id = s.claim_id""",
    ),
)
def export_join(spark, sf_dir):
    return joins.export_join(*_export_sides(spark, sf_dir))


def _export_sides(spark, sf_dir):
    upload = claims_raw(spark, sf_dir).select("row_idx", "claim_id", "total_claim_amount")
    shown = scored(spark, sf_dir).select("row_idx", "claim_id", "total_claim_amount", "final_risk_score", "risk_level")
    return upload, shown


@query(
    "export_join_unique",
    oracle(
        SCORED,
        """SELECT 'U' || u.row_idx AS claim_id, u.row_idx, u.total_claim_amount, s.total_claim_amount AS result_total_claim_amount,
  round(s.final_risk_score, 6) AS final_risk_score, s.risk_level
FROM claims_raw u FULL OUTER JOIN scored s ON u.row_idx = s.row_idx""",
    ),
)
def export_join_unique(spark, sf_dir):
    unique = [side.withColumn("claim_id", F.concat(F.lit("U"), "row_idx")) for side in _export_sides(spark, sf_dir)]
    return joins.export_join(*unique, literal_ids=True)


@query(
    "repeat_union",
    oracle(RAW, "SELECT c * (SELECT count(*) FROM claims_raw) + row_idx AS row_idx, claim_id FROM claims_raw CROSS JOIN range(3) r(c)"),
)
def repeat_union(spark, sf_dir):
    return joins.repeat_union(claims_raw(spark, sf_dir).select("row_idx", "claim_id"), 3)


# --- statistics --------------------------------------------------------------
TESTED = ["total_claim_amount", "log_claim_amount", "age"]


def _long(select: str) -> str:
    return " UNION ALL ".join(select.replace("$c", c) for c in TESTED)


VALUES = f"""{PREPARED},
long AS ({_long("SELECT '$c' AS col, CAST($c AS DOUBLE) AS x FROM prepared")}),
moments AS (SELECT col, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM long GROUP BY col)"""


@query("moments", oracle(VALUES, 'SELECT col AS "column", n, round(m, 6) AS mean, round(s, 6) AS std FROM moments'))
def moments(spark, sf_dir):
    return normality.moments(prepared(spark, sf_dir), TESTED)


def _weight(coefficients: list[float]) -> str:
    return " + ".join(f"CAST({c!r} AS DOUBLE) * pow(u, {i})" for i, c in enumerate(coefficients) if i)


NORMAL_SCORE = normal_ppf("(CAST(r AS DOUBLE) - 0.375e0) / (CAST(n AS DOUBLE) + 0.25e0)")

SHAPIRO = f"""{VALUES},
ordered AS (SELECT col, x, row_number() OVER (PARTITION BY col ORDER BY x) AS r, count(*) OVER (PARTITION BY col) AS n FROM long),
scores AS (SELECT *, {NORMAL_SCORE} AS m FROM ordered),
sums AS (SELECT col, max(n) AS n, sum(m * m) AS m2, max(m) AS m_last, max(m) FILTER (r = n - 1) AS m_next, 1 / sqrt(max(n)) AS u FROM scores GROUP BY col),
ends AS (SELECT *, {_weight(normality.LAST_WEIGHT)} + m_last / sqrt(m2) AS a_last, {_weight(normality.NEXT_WEIGHT)} + m_next / sqrt(m2) AS a_next FROM sums),
weights AS (SELECT *, (m2 - 2 * m_last ** 2 - 2 * m_next ** 2) / (1 - 2 * a_last ** 2 - 2 * a_next ** 2) AS eps FROM ends),
w AS (
  SELECT s.col, max(s.n) AS n,
    sum(s.x * CASE WHEN s.r = s.n THEN a_last WHEN s.r = 1 THEN -a_last WHEN s.r = s.n - 1 THEN a_next WHEN s.r = 2 THEN -a_next ELSE s.m / sqrt(eps) END) ** 2
      / (max(mo.s) ** 2 * (max(s.n) - 1)) AS w
  FROM scores s JOIN weights USING (col) JOIN moments mo USING (col) GROUP BY s.col),
shapiro AS (
  SELECT col, n, w, (ln(1 - w) - (-1.5861 - 0.31082 * ln(n) - 0.083751 * ln(n) ** 2 + 0.0038915 * ln(n) ** 3))
    / exp(-0.4803 - 0.082676 * ln(n) + 0.0030302 * ln(n) ** 2) AS z FROM w)"""
SHAPIRO_P = normal_cdf("(-z)")


@query("shapiro_wilk", oracle(SHAPIRO, f'SELECT col AS "column", n, round(w, 6) AS shapiro_stat, round({SHAPIRO_P}, 6) AS shapiro_pvalue FROM shapiro'))
def shapiro_wilk(spark, sf_dir):
    return normality.shapiro_wilk(prepared(spark, sf_dir), TESTED)


STANDARD = normal_cdf("((x - m) / s)")

KS = f"""{SHAPIRO},
steps AS (SELECT col, o.n, r, {STANDARD} AS cdf FROM ordered o JOIN moments USING (col)),
ks AS (SELECT col, max(n) AS n, max(greatest(r / n - cdf, cdf - (r - 1) / n)) AS d FROM steps GROUP BY col),
shifted AS (SELECT *, sqrt(n) * d + 1 / (6 * sqrt(n)) + (sqrt(n) * d - 1) / (4 * n) AS t FROM ks),
ks_tested AS (SELECT *, CASE WHEN t < 0.3 THEN 1 ELSE
  least(greatest(2 * (SELECT sum(pow(-1, k - 1) * exp(-2 * k * k * t * t)) FROM range(1, 101) q(k)), 0), 1) END AS p FROM shifted)"""


@query("ks_normal", oracle(KS, 'SELECT col AS "column", n, round(d, 6) AS ks_stat, round(p, 6) AS ks_pvalue FROM ks_tested'))
def ks_normal(spark, sf_dir):
    return normality.ks_normal(prepared(spark, sf_dir), TESTED)


REPORT = f"""{KS},
report AS (
  SELECT col, n, m, s, w, {SHAPIRO_P} AS sp, d, p AS kp FROM shapiro JOIN (SELECT col, d, p FROM ks_tested) USING (col)
  JOIN (SELECT col, m, s FROM moments) USING (col)),
advised AS (SELECT *, sp >= 0.05 AS sn, kp >= 0.05 AS kn, CASE WHEN sp >= 0.05 AND kp >= 0.05 THEN 'use_zscore'
  WHEN sp >= 0.05 OR kp >= 0.05 THEN 'use_zscore_with_caution' ELSE 'use_alternative_method' END AS recommendation FROM report)"""


@query(
    "normality_report",
    oracle(
        REPORT,
        """SELECT col AS "column", n, round(m, 6) AS mean, round(s, 6) AS std, round(w, 6) AS shapiro_stat, round(sp, 6) AS shapiro_pvalue,
  round(d, 6) AS ks_stat, round(kp, 6) AS ks_pvalue, sn AS shapiro_normal, kn AS ks_normal, sn AND kn AS is_normal, recommendation FROM advised""",
    ),
)
def normality_report(spark, sf_dir):
    return normality.normality_report(prepared(spark, sf_dir), TESTED)


@query(
    "normality_summary",
    oracle(
        REPORT,
        """SELECT col AS "column", n AS sample_size, round(sp, 6) AS shapiro_pvalue, round(kp, 6) AS ks_pvalue, sn AND kn AS is_normal, recommendation FROM advised""",
    ),
)
def normality_summary(spark, sf_dir):
    return normality.normality_summary(prepared(spark, sf_dir), TESTED)


@query("should_use_zscore", oracle(REPORT, """SELECT col AS "column", recommendation <> 'use_alternative_method' AS use_zscore FROM advised"""))
def should_use_zscore(spark, sf_dir):
    return normality.should_use_zscore(prepared(spark, sf_dir), TESTED)


QQ_SCORE = normal_ppf("0.01e0 + 0.98e0 * (r - 1) / (n - 1)")
QQ = f"""{VALUES},
ordered AS (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM long WHERE col = 'total_claim_amount'),
points AS (SELECT r AS rank, {QQ_SCORE} AS theoretical, (x - m) / s AS sample
  FROM ordered CROSS JOIN (SELECT m, s FROM moments WHERE col = 'total_claim_amount'))"""


@query("qq_points", oracle(QQ, "SELECT rank, round(theoretical, 6) AS theoretical, round(sample, 6) AS sample FROM points"))
def qq_points(spark, sf_dir):
    return normality.qq_points(prepared(spark, sf_dir), "total_claim_amount")


@query(
    "qq_line",
    oracle(QQ, "SELECT round(least(min(theoretical), min(sample)), 6) AS line_min, round(greatest(max(theoretical), max(sample)), 6) AS line_max FROM points"),
)
def qq_line(spark, sf_dir):
    return normality.qq_line(normality.qq_points(prepared(spark, sf_dir), "total_claim_amount"))


IQR = f"""{VALUES},
quartiles AS (SELECT col, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM long GROUP BY col)"""


@query(
    "iqr_bounds",
    oracle(
        IQR,
        """SELECT col AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound,
  round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound FROM quartiles""",
    ),
)
def iqr_bounds(spark, sf_dir):
    return normality.iqr_bounds(prepared(spark, sf_dir), TESTED)


@query(
    "outlier_flags",
    oracle(
        IQR,
        """SELECT row_idx, 'iqr' AS outlier_method, CAST(total_claim_amount < q1 - 1.5 * (q3 - q1) OR total_claim_amount > q3 + 1.5 * (q3 - q1) AS BIGINT) AS is_outlier
FROM prepared CROSS JOIN (SELECT q1, q3 FROM quartiles WHERE col = 'total_claim_amount')""",
    ),
)
def outlier_flags(spark, sf_dir):
    flagged = normality.outlier_flags(cleaning.clean_claims(claims_raw(spark, sf_dir)), "total_claim_amount")
    return flagged.select("row_idx", "outlier_method", "is_outlier")


@query(
    "outlier_flags_zscore",
    oracle(
        VALUES,
        """SELECT row_idx, 'zscore' AS outlier_method, CAST(coalesce(abs((log_claim_amount - m) / s) > 3, false) AS BIGINT) AS is_outlier
FROM prepared CROSS JOIN (SELECT m, s FROM moments WHERE col = 'log_claim_amount')""",
    ),
)
def outlier_flags_zscore(spark, sf_dir):
    flagged = normality.outlier_flags(prepared(spark, sf_dir), "log_claim_amount", method="zscore")
    return flagged.select("row_idx", "outlier_method", "is_outlier")


# --- sources and sinks -------------------------------------------------------
BANDS = "CASE WHEN score >= 70 THEN 'High' WHEN score >= 30 THEN 'Medium' ELSE 'Low' END"
EXPORTED = f"""SELECT claim_id, total_claim_amount, round(score, 6) AS final_risk_score, {BANDS} AS risk_level,
  CASE WHEN score >= 70 THEN 'Fraud' ELSE 'Legitimate' END AS fraud_prediction, round(p, 6) AS ml_fraud_probability, explanation FROM worded"""

#: Every fiftieth claim has a type with quotes and a line break.
BROKEN_TYPE = "CASE WHEN row_idx % 50 = 0 THEN incident_type || {feed} || '\"second\" line' ELSE incident_type END"
#: All columns of an upload as text; {kind} is the text type, {feed} a line feed.
UPLOAD_COLUMNS = {
    "claim_id": "claim_id", "policy_number": "policy_number", "total_claim_amount": "CAST(CAST(total_claim_amount AS BIGINT) AS {kind})",
    "incident_hour_of_the_day": "CAST(incident_hour_of_the_day AS {kind})", "incident_ts": "CAST(CAST(incident_ts AS DATE) AS {kind}) || '_' || CAST(minute(incident_ts) AS {kind})",
    "incident_date": "CAST(incident_date AS {kind})", "age": "CAST(age AS {kind})", "incident_state": "incident_state", "incident_severity": "incident_severity",
    "incident_type": BROKEN_TYPE, "witnesses": "CAST(witnesses AS {kind})", "police_report_available": "police_report_available",
    "authorities_contacted": "authorities_contacted", "property_damage": "property_damage", "policy_bind_year": "CAST(policy_bind_year AS {kind})",
    "injury_claim": "CAST(CAST(injury_claim AS BIGINT) AS {kind})", "property_claim": "CAST(CAST(property_claim AS BIGINT) AS {kind})",
    "vehicle_claim": "CAST(CAST(vehicle_claim AS BIGINT) AS {kind})", "fraud_reported": "fraud_reported",
}


def _upload_columns(kind: str, feed: str) -> list[str]:
    return [f"{value.format(kind=kind, feed=feed)} AS {name}" for name, value in UPLOAD_COLUMNS.items()]


def _written_upload(spark, sf_dir, feed: str) -> str:
    """The upload as CSV in two folders whose headers differ in order; files in upload order, so the row index must give the order back."""
    path = scratch_path(spark, "upload")
    upload = claims_raw(spark, sf_dir).selectExpr("row_idx", *_upload_columns("STRING", feed))
    half = upload.agg((F.max("row_idx") / 2).alias("h")).scalar()
    names = list(UPLOAD_COLUMNS)
    for folder, rows, columns in (("1", F.col("row_idx") < half, names), ("2", F.col("row_idx") >= half, names[::-1])):
        part = upload.where(rows).repartitionByRange(4, "row_idx").sortWithinPartitions("row_idx")
        part.select(*columns).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/{folder}")
    return f"{path}/*"


@query("read_claims_csv", oracle(RAW, f"SELECT row_idx, {', '.join(_upload_columns('VARCHAR', 'chr(10)'))} FROM claims_raw"))
def read_claims_csv(spark, sf_dir):
    # Ranges smaller than the files, so that many begin inside a record.
    return files.read_claims_csv(spark, _written_upload(spark, sf_dir, "char(10)"), multi_line=True, range_bytes=1 << 20)


@query("read_claims_csv_lines", oracle(RAW, f"SELECT row_idx, {', '.join(_upload_columns('VARCHAR', 'chr(9)'))} FROM claims_raw"))
def read_claims_csv_lines(spark, sf_dir):
    return files.read_claims_csv(spark, _written_upload(spark, sf_dir, "char(9)"), range_bytes=1 << 20)


@query("write_results_csv", oracle(MODELLED, EXPORTED))
def write_results_csv(spark, sf_dir):
    path = scratch_path(spark, "results-csv")
    files.write_results_csv(scored_with_model(spark, sf_dir), path)
    return files.read_results_csv(spark, path)


@query("write_results_json", oracle(MODELLED, EXPORTED))
def write_results_json(spark, sf_dir):
    path = scratch_path(spark, "results-json")
    exported = files.results_columns(scored_with_model(spark, sf_dir))
    files.write_results_json(exported, path)
    return files.read_results_json(spark, path, exported.schema)


RECORD = """count(*) AS claims_count, count(*) FILTER (risk_level = 'High') AS high_risk_count,
  count(*) FILTER (risk_level = 'Medium') AS medium_risk_count, count(*) FILTER (risk_level = 'Low') AS low_risk_count,
  round(coalesce(avg(final_risk_score), 0), 6) AS avg_risk_score, count(*) FILTER (fraud_prediction = 'Fraud') AS fraud_predictions"""


@query(
    "store_run",
    oracle(
        SCORED,
        " UNION ALL ".join(
            f"SELECT '{name}' AS run_id, {RECORD}, CAST({runtime} AS DOUBLE) AS runtime FROM scored WHERE {rows}"
            for name, runtime, rows in (("007", 1.5, "risk_level = 'High'"), ("run1", 2.5, "risk_level <> 'High'"), ("empty", 0.5, "false"))
        ),
    ),
)
def store_run(spark, sf_dir):
    path = scratch_path(spark, "runs")
    frame = scored(spark, sf_dir)
    files.store_run(frame.where("risk_level = 'High'"), path, "007", 1.5)
    # A run stored twice, and one that broke off before its commit.
    files.store_run(frame.where("risk_level = 'Low'"), path, "run1", 9.5)
    files.store_run(frame.where("risk_level <> 'High'"), path, "run1", 2.5)
    files.store_run(frame.where("false"), path, "empty", 0.5)
    frame.selectExpr("*", "'broken' AS run_id").limit(1).write.parquet(f"{path}/data/broken")
    return files.read_runs(spark, path).drop("timestamp")


@query("append_results", oracle(MODELLED, EXPORTED))
def append_results(spark, sf_dir):
    path = scratch_path(spark, "appended")
    exported = files.results_columns(scored_with_model(spark, sf_dir))
    for batch, rows in (("high", "risk_level = 'High'"), ("others", "risk_level <> 'High'"), ("high", "risk_level = 'High'")):
        files.append_results(exported.where(rows), path, batch)
    return files.all_results(spark, path)


#: Runs that are stored one after another, with the rows of each.
STORED_RUNS = {"north": "incident_state = 'OH'", "east": "incident_state = 'NY'", "west": "incident_state = 'CA'", "south": "incident_state IN ('TX', 'IN')"}


def _store(spark, sf_dir) -> RunStore:
    store = RunStore(spark, scratch_path(spark, "runs"))
    frame = timestamp_by_quarter(scored(spark, sf_dir)).drop("run_id")
    for place, (name, rows) in enumerate(STORED_RUNS.items()):
        store.store(frame.where(rows), name, 1.0, F.timestamp_seconds(F.lit(place)))
    return store


@query(
    "retain_stored_runs",
    oracle(SCORED, "SELECT row_idx, CASE WHEN incident_state = 'CA' THEN 'west' ELSE 'south' END AS run_id, round(final_risk_score, 6) AS final_risk_score FROM scored WHERE incident_state IN ('CA', 'TX', 'IN')"),
)
def retain_stored_runs(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.compact()
    store.retain(2)
    store.compact()
    store.vacuum(older_than=0)
    return store.results().select("row_idx", "run_id", "final_risk_score")


@query(
    "rollup_counts",
    oracle(
        RESULTS,
        """SELECT 'day' AS kind, strftime(timestamp, '%Y-%m-%d') AS item, count(*) AS n FROM results GROUP BY 2
UNION ALL SELECT 'band', risk_level, count(*) FROM results GROUP BY 2
UNION ALL SELECT 'rule', rule, count(*) FROM (SELECT unnest(indicators) AS rule FROM results) GROUP BY 2""",
    ),
)
def rollup_counts(spark, sf_dir):
    rolled = _store(spark, sf_dir).rollup()
    parts = [history.rollup_counts(rolled, kind, "item").select(F.lit(kind).alias("kind"), "item", "n") for kind in ("day", "band", "rule")]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "rollup_kpis",
    oracle(
        SCORED,
        """SELECT count(*) AS total_analyzed, count(*) FILTER (risk_level = 'High') AS flagged_count, round(avg(final_risk_score), 6) AS avg_risk_score,
  count(*) FILTER (risk_level = 'High') AS high_risk_count, round(count(*) FILTER (risk_level = 'High') / count(*) * 100, 6) AS fraud_rate FROM scored""",
    ),
)
def rollup_kpis(spark, sf_dir):
    return history.rollup_kpis(_store(spark, sf_dir).rollup())


#: The runs' rows by the state they were stored by.
RUN_ROWS = "run_rows AS (SELECT claim_id, CASE incident_state " + " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in (("OH", "north"), ("NY", "east"), ("CA", "west"))) + " ELSE 'south' END AS run_id FROM raw_scored)"
RAW_SCORED = SCORED + """,
raw_scored AS (SELECT c.claim_id, s.incident_state FROM scored s JOIN claims_raw c USING (row_idx))"""


def _store_uploaded_ids(spark, sf_dir) -> RunStore:
    """The runs with the ids as uploaded, so that many occur in several runs."""
    store = RunStore(spark, scratch_path(spark, "runs"))
    ids = claims_raw(spark, sf_dir).select("row_idx", "claim_id")
    frame = scored(spark, sf_dir).drop("claim_id").join(ids, "row_idx").select("row_idx", "claim_id", "incident_state", "final_risk_score", "risk_level", "fraud_prediction")
    frame = stored(frame, "uploaded-ids")
    for place, (name, rows) in enumerate(STORED_RUNS.items()):
        store.store(frame.where(rows), name, 1.0, F.timestamp_seconds(F.lit(place)))
    return store


@query("stored_repeated_ids", oracle(f"{RAW_SCORED}, {RUN_ROWS}", "SELECT claim_id, count(DISTINCT run_id) AS runs, count(*) AS n FROM run_rows WHERE claim_id IS NOT NULL GROUP BY claim_id HAVING count(DISTINCT run_id) > 1"))
def stored_repeated_ids(spark, sf_dir):
    return _store_uploaded_ids(spark, sf_dir).repeated_ids()


@query("stored_duplicate_ids", oracle(f"{RAW_SCORED}, {RUN_ROWS}", "SELECT count(*) - count(DISTINCT coalesce(claim_id, '-')) AS duplicate_ids FROM run_rows"))
def stored_duplicate_ids(spark, sf_dir):
    return _store_uploaded_ids(spark, sf_dir).count_duplicate_ids()


#: A quantile from sketches is right if its rank in all values is.
@query("rollup_quantiles", oracle(RAW, "SELECT c.col, true AS close_25, true AS close_50, true AS close_95 FROM (VALUES ('total_claim_amount'), ('final_risk_score')) c(col)"))
def rollup_quantiles(spark, sf_dir):
    store = _store(spark, sf_dir)
    shares = {"q25": 0.25, "q50": 0.5, "q95": 0.95}
    found = history.rollup_quantiles(store.rollup(), shares)
    results = store.results()
    values = results.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in history.SKETCHED])))
    joined = values.join(found, "col")
    close = [
        (((F.count_if(F.col("value") < F.col(q)) / F.count("*")) <= share + 0.01) & ((F.count_if(F.col("value") <= F.col(q)) / F.count("*")) >= share - 0.01)).alias(f"close_{q[1:]}")
        for q, share in shares.items()
    ]
    return joined.groupBy("col").agg(*close)


KEPT = f"""{RUNS},
kept AS (SELECT * FROM runs ORDER BY runs.timestamp DESC, run_id DESC LIMIT 50)"""


@query(
    "export_session_json",
    oracle(
        KEPT,
        f"""SELECT '2024-02-01 00:00:00' AS exported, (SELECT count(*) FROM kept) AS total_analyses, (SELECT CAST(sum(claims_count) AS BIGINT) FROM kept) AS total_claims,
  (SELECT round(sum(runtime), 6) FROM kept) AS total_runtime, (SELECT round(sum(high_risk_count) / sum(claims_count) * 100, 6) FROM kept) AS high_risk_rate,
  row_number() OVER (ORDER BY kept.timestamp) AS place, {STAMP}, {COUNTS}, round(runtime, 6) AS runtime FROM kept""",
    ),
)
def export_session_json(spark, sf_dir):
    exported = history.export_session_json(runs(spark, sf_dir), now=F.expr(f"timestamp {quoted(NOW)}"))
    # The text is read back, so that each of its values can be compared.
    record = "timestamp timestamp, claims_count long, high_risk_count long, medium_risk_count long, low_risk_count long, avg_risk_score double, fraud_predictions long, runtime double"
    stats = "total_analyses long, total_claims long, total_runtime double, high_risk_rate double"
    parsed = exported.select(F.from_json("session_json", f"export_timestamp timestamp, session_statistics struct<{_fields(stats)}>, analysis_history array<struct<{_fields(record)}>>").alias("j"))
    listed = parsed.select(F.date_format("j.export_timestamp", "yyyy-MM-dd HH:mm:ss").alias("exported"), "j.session_statistics.*", F.posexplode("j.analysis_history").alias("pos", "run"))
    return _stamped(listed.select("exported", "total_analyses", "total_claims", "total_runtime", "high_risk_rate", (F.col("pos") + 1).alias("place"), "run.*"))


def _fields(columns: str) -> str:
    return ", ".join(": ".join(c.split()) for c in columns.split(", "))
