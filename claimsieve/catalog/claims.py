"""Queries of mapping, cleaning, features, rules and scoring."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from .. import schema as S
from ..fixtures import claims_raw
from ..operators import cleaning, features, fusion, mapping, policy, rules, views
from ..session import scratch_path
from ..streaming.history import stream_policy_history as stream_policy_history_of
from .base import (
    CLEANED,
    PREPARED,
    PROBABILITY,
    RAW,
    RULE_SQL,
    RULED,
    SCORED,
    oracle,
    prepared,
    query,
    ruled,
    scored,
    with_probability,
)

# --- mapping -----------------------------------------------------------------
#: Upload names whose inference gives back the canonical fields.
UPLOAD_NAMES = {
    "claim_id": "ClaimNumber",
    "total_claim_amount": "Amount",
    "incident_hour_of_the_day": "HourOfDay",
    "age": "DriverAge",
    "incident_type": "IncidentType",
    "incident_severity": "SeverityText",
    "witnesses": "WitnessCount",
    "police_report_available": "PoliceReport",
}
CORE = list(UPLOAD_NAMES)


def _upload(spark, sf_dir):
    raw = claims_raw(spark, sf_dir)
    return raw.select("row_idx", *[F.col(c).alias(UPLOAD_NAMES[c]) for c in CORE])


@query("map_columns", oracle(RAW, f"SELECT row_idx, {', '.join(CORE)} FROM claims_raw"))
def map_columns(spark, sf_dir):
    return mapping.map_columns(_upload(spark, sf_dir), UPLOAD_NAMES)


@query("infer_column_mapping", oracle(RAW, f"SELECT row_idx, {', '.join(CORE)} FROM claims_raw"))
def infer_column_mapping(spark, sf_dir):
    upload = _upload(spark, sf_dir)
    names = [c for c in upload.columns if c != S.ROW_INDEX]
    inferred = mapping.infer_column_mapping(names, skip_taken=True)
    return mapping.map_columns(upload, inferred).select("row_idx", *CORE)


#: Without skipping, the first column with "claim" in its name serves both the id and the amount.
SHARED = {**UPLOAD_NAMES, "total_claim_amount": "ClaimNumber"}


@query(
    "infer_column_mapping_shared",
    oracle(
        RAW,
        " UNION ALL ".join(
            f"SELECT '{f}' AS field, '{s}' AS source, count({'claim_id' if s == 'ClaimNumber' else f}) AS n FROM claims_raw" for f, s in SHARED.items()
        ),
    ),
)
def infer_column_mapping_shared(spark, sf_dir):
    upload = _upload(spark, sf_dir)
    inferred = mapping.infer_column_mapping([c for c in upload.columns if c != S.ROW_INDEX])
    counts = upload.agg(*[F.count(source).alias(field) for field, source in inferred.items()])
    rows = ", ".join(f"named_struct('field', '{f}', 'source', '{s}', 'n', `{f}`)" for f, s in inferred.items())
    return counts.selectExpr(f"inline(array({rows}))")


@query(
    "ensure_required",
    oracle(RAW, "SELECT row_idx, total_claim_amount, 'CLM_' || row_idx AS claim_id, CAST(12 AS BIGINT) AS incident_hour_of_the_day FROM claims_raw"),
)
def ensure_required(spark, sf_dir):
    return mapping.ensure_required(claims_raw(spark, sf_dir).select("row_idx", "total_claim_amount"))


@query("dedupe_claim_ids", oracle(CLEANED, "SELECT row_idx, claim_id FROM deduped"))
def dedupe_claim_ids(spark, sf_dir):
    return mapping.dedupe_claim_ids(claims_raw(spark, sf_dir).select("row_idx", "claim_id"))


@query("count_duplicate_ids", oracle(RAW, "SELECT count(*) - count(DISTINCT claim_id) AS duplicate_ids FROM claims_raw"))
def count_duplicate_ids(spark, sf_dir):
    return mapping.count_duplicate_ids(claims_raw(spark, sf_dir))


# --- cleaning ----------------------------------------------------------------
def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


#: Claims as text, with values that are no usable number in some rows; the same SQL in both engines.
EDGES = {
    "total_claim_amount": ["abc", "NaN", "inf", "-inf", "-5", "0", "0.5", "9999.99", "300000.01", ""],
    "incident_hour_of_the_day": ["-3", "40", "5.5", "x", "NaN", "inf", "23"],
    "age": ["10", "140", "abc", "NaN", "24.5"],
    "witnesses": ["-1", "99", "many", "inf", "10"],
}


def _edge_text(column, values):
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE row_idx % {41 + len(values)} {cases} ELSE CAST(CAST({column} AS BIGINT) AS STRING) END AS {column}"


EDGED_SQL = f"SELECT row_idx, claim_id, {', '.join(_edge_text(c, v) for c, v in EDGES.items())} FROM {{claims}}"
EDGED = f"""{RAW},
edged AS ({EDGED_SQL.format(claims="claims_raw").replace("STRING", "VARCHAR")}),
numbers AS (SELECT row_idx, {', '.join(f"CASE WHEN isfinite(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END AS {c}" for c in EDGES)} FROM edged)"""


def _edged(spark, sf_dir):
    return spark.sql(EDGED_SQL, claims=claims_raw(spark, sf_dir))


@query("clean_amount", oracle(EDGED, "SELECT row_idx, total_claim_amount FROM numbers WHERE total_claim_amount > 0"))
def clean_amount(spark, sf_dir):
    return cleaning.clean_amount(_edged(spark, sf_dir)).select("row_idx", "total_claim_amount")


def _clean(name, expression, column, clean):
    @query(name, oracle(EDGED, f"SELECT row_idx, CAST({expression} AS DOUBLE) AS {column} FROM numbers"))
    def build(spark, sf_dir):
        return clean(_edged(spark, sf_dir)).select("row_idx", column)


_clean("clean_hour", "least(greatest(coalesce(incident_hour_of_the_day, 12), 0), 23)", "incident_hour_of_the_day", cleaning.clean_hour)
_clean("clean_age", "least(greatest(coalesce(age, 35), 18), 100)", "age", cleaning.clean_age)
_clean("clean_witnesses", "least(greatest(coalesce(witnesses, 1), 0), 10)", "witnesses", cleaning.clean_witnesses)

FEATURES = [
    "log_claim_amount", "amount_category", "is_round_amount", "hour_category", "unusual_hour", "age_group", "young_driver",
    "severity_numeric", "high_risk_state", "first_digit", "benford_anomaly_score", "amount_per_age", "high_amount_no_witnesses",
]
DOUBLES = {"log_claim_amount", "severity_numeric", "benford_anomaly_score", "amount_per_age"}
NUMBERS = ["total_claim_amount", "incident_hour_of_the_day", "age", "witnesses"]


def _shown(names):
    return ", ".join(f"round({n}, 6) AS {n}" if n in DOUBLES else n for n in names)


@query("prepare_claims", oracle(PREPARED, f"SELECT row_idx, claim_id, {', '.join(NUMBERS)}, {_shown(FEATURES)} FROM prepared"))
def prepare_claims_query(spark, sf_dir):
    return prepared(spark, sf_dir).select("row_idx", "claim_id", *NUMBERS, *FEATURES)


@query(
    "validate_claims",
    oracle(
        EDGED,
        f"""SELECT row_idx, reject_reason, CAST(reject_reason IS NULL AS BIGINT) AS accepted FROM (SELECT e.row_idx, CASE
  WHEN e.claim_id IS NULL OR e.total_claim_amount IS NULL OR e.incident_hour_of_the_day IS NULL THEN {_quoted(cleaning.MISSING_FIELDS)}
  WHEN n.total_claim_amount <= 0 OR e.total_claim_amount = '-inf' THEN {_quoted(cleaning.NOT_POSITIVE)}
  WHEN e.total_claim_amount IN ('NaN', 'inf') THEN {_quoted(cleaning.FILTERED_OUT)}
  WHEN n.total_claim_amount IS NULL THEN {_quoted(cleaning.NOT_NUMERIC)} END AS reject_reason
FROM edged e JOIN numbers n USING (row_idx))""",
    ),
)
def validate_claims(spark, sf_dir):
    good, bad = cleaning.validate_claims(_edged(spark, sf_dir))
    return good.selectExpr("row_idx", "CAST(NULL AS STRING) AS reject_reason", "1 AS accepted").union(
        bad.selectExpr("row_idx", "reject_reason", "0 AS accepted")
    )


@query(
    "numeric_features",
    oracle(
        PREPARED,
        "SELECT row_idx, "
        + ", ".join(f"CAST(round({c}, 6) AS DOUBLE) AS {c}" for c in S.MODEL_FEATURES)
        + " FROM prepared",
    ),
)
def numeric_features(spark, sf_dir):
    frame = prepared(spark, sf_dir)
    return features.align_features(frame, features.numeric_features(frame), ["row_idx"])


PROFILE_ORDER = (
    "total_claim_amount log_claim_amount is_round_amount incident_hour_of_the_day unusual_hour age young_driver "
    "severity_numeric high_risk_state benford_anomaly_score amount_per_age high_amount_no_witnesses witnesses first_digit"
).split()


@query(
    "profile_features",
    oracle(
        PREPARED,
        " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS feature, round(CAST(sum({c}) AS DOUBLE) / count(*), 6) AS mean FROM prepared" for i, c in enumerate(PROFILE_ORDER)),
    ),
)
def profile_features(spark, sf_dir):
    """The numeric features in the order of the upload profile, with their means."""
    frame = prepared(spark, sf_dir)
    names = features.numeric_features(frame, S.PROFILE_FEATURES)
    rows = ", ".join(f"named_struct('position', {i}, 'feature', '{c}', 'mean', `{c}`)" for i, c in enumerate(names))
    return frame.agg(*[F.avg(c).alias(c) for c in names]).selectExpr(f"inline(array({rows}))")


@query(
    "align_features",
    oracle(CLEANED, "SELECT row_idx, witnesses, CAST(0 AS DOUBLE) AS claim_frequency, age, total_claim_amount FROM cleaned"),
)
def align_features(spark, sf_dir):
    frame = cleaning.clean_claims(claims_raw(spark, sf_dir))
    return features.align_features(frame, ["witnesses", "claim_frequency", "age", "total_claim_amount"], ["row_idx"])


# --- row features ------------------------------------------------------------
def _feature(name):
    @query(name, oracle(PREPARED, f"SELECT row_idx, {_shown([name])} FROM prepared"))
    def build(spark, sf_dir):
        cleaned = cleaning.clean_claims(claims_raw(spark, sf_dir))
        frame = features.engineer_features(cleaned) if name == "benford_anomaly_score" else features.row_features(cleaned)
        return frame.select("row_idx", name)


for _name in FEATURES:
    _feature(_name)


@query(
    "benford_digit_table",
    oracle(PREPARED, "SELECT CAST(digit AS BIGINT) AS digit, expected, round(actual, 6) AS actual FROM digit_table"),
)
def benford_digit_table(spark, sf_dir):
    return features.benford_digit_table(cleaning.clean_amount(claims_raw(spark, sf_dir)))


# --- dictionary features -----------------------------------------------------
BOUND = "make_date(policy_bind_year, 1, 1)"


def _policy_claims(spark, sf_dir):
    cleaned = cleaning.clean_claims(claims_raw(spark, sf_dir))
    return cleaned.selectExpr("*", "make_date(CAST(policy_bind_year AS INT), 1, 1) AS policy_bind_date")


STATISTICS = f"""{CLEANED},
claims AS (SELECT *, {BOUND} AS policy_bind_date, CAST(CAST(incident_date AS DATE) - DATE '1970-01-01' AS BIGINT) AS epoch FROM cleaned),
stats AS (SELECT avg(total_claim_amount) AS m, stddev_samp(total_claim_amount) AS s,
  quantile_cont(total_claim_amount, 0.25) AS q1, quantile_cont(total_claim_amount, 0.75) AS q3 FROM claims)"""

PARTS = "[injury_claim, property_claim, vehicle_claim, total_claim_amount]"
DICTIONARY = {
    "incident_day_of_week": "CAST(isodow(incident_date) AS BIGINT)",
    "incident_month": "CAST(month(incident_date) AS BIGINT)",
    "incident_hour_bin": "CASE WHEN incident_hour_of_the_day <= 6 THEN 'Late Night' WHEN incident_hour_of_the_day <= 12 THEN 'Morning' "
    "WHEN incident_hour_of_the_day <= 18 THEN 'Afternoon' ELSE 'Evening' END",
    "customer_tenure_years": "round(date_diff('day', policy_bind_date, incident_date) / 365.25, 6)",
    "claim_mean": f"round(list_avg({PARTS}), 6)",
    "claim_std_dev": f"round(list_stddev_samp({PARTS}), 6)",
    "leading_digit": "CAST(substr(CAST(CAST(floor(total_claim_amount) AS BIGINT) AS VARCHAR), 1, 1) AS BIGINT)",
    "benford_expected": "CASE CAST(substr(CAST(CAST(floor(total_claim_amount) AS BIGINT) AS VARCHAR), 1, 1) AS BIGINT) "
    + " ".join(f"WHEN {d} THEN CAST({e} AS DOUBLE)" for d, e in S.BENFORD_SHARES.items())
    + " END",
    "benford_flag": "CAST(substr(CAST(CAST(floor(total_claim_amount) AS BIGINT) AS VARCHAR), 1, 1) IN ('8', '9') AS BIGINT)",
    "rule_unusual_hour": "CAST(incident_hour_of_the_day BETWEEN 1 AND 5 AS BIGINT)",
    "rule_suspicious_missing": "CAST(upper(police_report_available) = 'UNKNOWN' OR upper(property_damage) = 'UNKNOWN' AS BIGINT)",
    "flag_no_authorities_contacted": "CAST(coalesce(authorities_contacted, 'None') IN ('None', 'Not Reported') AS BIGINT)",
}
HISTORY = {
    "days_since_last_claim": "coalesce(epoch - lag(epoch) OVER (PARTITION BY policy_number ORDER BY epoch, row_idx), -1)",
    "claims_last_30d": "count(*) OVER (PARTITION BY policy_number ORDER BY epoch RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)",
    "rule_high_frequency": "CAST(count(*) OVER (PARTITION BY policy_number ORDER BY epoch RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) > 3 AS BIGINT)",
}
BATCH = {
    "claim_percentile_rank": (
        "round((rank() OVER (ORDER BY total_claim_amount) + (count(*) OVER (PARTITION BY total_claim_amount) - 1) / 2.0) / count(*) OVER (), 6)",
        policy.percentile_rank,
    ),
    "zscore_total_claim": ("round((total_claim_amount - m) / s, 6)", policy.amount_zscore),
    "anomaly_zscore": ("CAST(abs((total_claim_amount - m) / s) > 3 AS BIGINT)", policy.amount_zscore),
    "iqr_flag": (
        "CAST(total_claim_amount NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS BIGINT)",
        policy.iqr_flag,
    ),
    "duplicate_amount": ("CAST(count(*) OVER (PARTITION BY total_claim_amount) > 1 AS BIGINT)", policy.duplicate_amount),
}


def _dictionary(name, sql, build_frame):
    @query(name, oracle(STATISTICS, f"SELECT row_idx, {sql} AS {name} FROM claims CROSS JOIN stats"))
    def build(spark, sf_dir):
        return build_frame(_policy_claims(spark, sf_dir)).select("row_idx", name)


for _name, _sql in DICTIONARY.items():
    _dictionary(_name, _sql, policy.row_dictionary_features)
for _name, _sql in HISTORY.items():
    _dictionary(_name, _sql, policy.policy_history)
for _name, (_sql, _build) in BATCH.items():
    _dictionary(_name, _sql, _build)

ALL_DICTIONARY = {**DICTIONARY, **HISTORY, **{n: s for n, (s, _) in BATCH.items()}}


@query(
    "dictionary_features",
    oracle(STATISTICS, f"SELECT row_idx, {', '.join(f'{s} AS {n}' for n, s in ALL_DICTIONARY.items())} FROM claims CROSS JOIN stats"),
)
def dictionary_features(spark, sf_dir):
    return policy.dictionary_features(_policy_claims(spark, sf_dir)).select("row_idx", *ALL_DICTIONARY)


@query("stream_policy_history", oracle(STATISTICS, f"SELECT row_idx, {', '.join(f'{s} AS {n}' for n, s in HISTORY.items())} FROM claims"))
def stream_policy_history(spark, sf_dir):
    """The claims as a stream of files in random order. One claim far ahead lets the watermark pass all others."""
    path = scratch_path(spark, "claim-stream")
    claims = _policy_claims(spark, sf_dir).select("row_idx", "policy_number", "incident_date")
    first, last = claims.agg(F.min("incident_date"), F.max("incident_date")).first()
    claims.repartition(4, F.xxhash64("row_idx")).write.parquet(f"{path}/in")
    span = (last - first).days + 1
    ahead = spark.range(1).select(F.lit(-1).cast("long").alias("row_idx"), F.lit("ahead").alias("policy_number"), F.lit(last + timedelta(days=2 * span)).alias("incident_date"))
    arriving = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    columns = ["row_idx", *HISTORY]
    out = stream_policy_history_of(arriving, delay=f"{span} days").select(*columns)
    for more in (None, ahead.select(claims.columns)):
        if more is not None:
            more.write.mode("append").parquet(f"{path}/in")
        writer = out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        writer.option("checkpointLocation", f"{path}/progress").start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out")


# --- rules -------------------------------------------------------------------
def _rule(name):
    key = {"rule_unusual_hour_list": "unusual_hour"}.get(name, name.removeprefix("rule_"))

    @query(name, oracle(RULED, f"SELECT row_idx, CAST(r_{key} AS BIGINT) AS {name} FROM flagged"))
    def build(spark, sf_dir):
        cleaned = cleaning.clean_claims(claims_raw(spark, sf_dir))
        return rules.rule_flags(cleaned).select("row_idx", F.col(f"rule_{key}").alias(name))


for _name in RULE_SQL:
    # The dictionary flag of hours 1 to 5 already owns the plain name.
    _rule("rule_unusual_hour_list" if _name == "unusual_hour" else f"rule_{_name}")


@query("combo_multiplier", oracle(RULED, "SELECT row_idx, round(combo_multiplier, 6) AS combo_multiplier FROM ruled"))
def combo_multiplier(spark, sf_dir):
    return rules.apply_rules(cleaning.clean_claims(claims_raw(spark, sf_dir))).select("row_idx", "combo_multiplier")


@query("rule_score", oracle(RULED, "SELECT row_idx, claim_id, round(risk_score, 6) AS risk_score FROM ruled"))
def rule_score(spark, sf_dir):
    return ruled(spark, sf_dir).select("row_idx", "claim_id", "risk_score")


@query(
    "top_indicators",
    oracle(RULED, "SELECT row_idx, array_to_string(indicators, ' | ') AS top_indicators, triggered_rules FROM ruled"),
)
def top_indicators(spark, sf_dir):
    return rules.apply_rules(cleaning.clean_claims(claims_raw(spark, sf_dir))).select("row_idx", "top_indicators", "triggered_rules")


# --- fusion and decisions ----------------------------------------------------
FUSED = f"""{RULED},
predicted AS (SELECT *, {PROBABILITY} AS p FROM ruled),
fused AS (SELECT * EXCLUDE (risk_score), CASE WHEN p IS NULL THEN risk_score ELSE CAST(0.6 AS DOUBLE) * risk_score + CAST(0.4 AS DOUBLE) * p * 100 END AS risk_score FROM predicted)"""


@query("combine_predictions", oracle(FUSED, "SELECT row_idx, round(p, 6) AS ml_fraud_prob, round(risk_score, 6) AS risk_score FROM fused"))
def combine_predictions(spark, sf_dir):
    return fusion.combine_predictions(with_probability(ruled(spark, sf_dir))).select("row_idx", "ml_fraud_prob", "risk_score")


@query("join_predictions", oracle(FUSED, "SELECT row_idx, claim_id, round(risk_score, 6) AS risk_score FROM fused"))
def join_predictions(spark, sf_dir):
    frame = ruled(spark, sf_dir)
    predictions = with_probability(frame.select("row_idx", "claim_id"))
    return fusion.join_predictions(frame, predictions).select("row_idx", "claim_id", "risk_score")


@query("risk_level", oracle(SCORED, "SELECT row_idx, risk_level FROM scored"))
def risk_level(spark, sf_dir):
    return ruled(spark, sf_dir).select("row_idx", fusion.risk_level(F.col("risk_score")).alias("risk_level"))


@query("fraud_prediction", oracle(SCORED, "SELECT row_idx, fraud_prediction FROM scored"))
def fraud_prediction(spark, sf_dir):
    return ruled(spark, sf_dir).select("row_idx", fusion.fraud_prediction(F.col("risk_score")).alias("fraud_prediction"))


@query(
    "score_claims",
    oracle(
        SCORED,
        "SELECT row_idx, claim_id, total_claim_amount, round(final_risk_score, 6) AS final_risk_score, risk_level, fraud_prediction, "
        "triggered_rules FROM scored",
    ),
)
def score_claims(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "row_idx", "claim_id", "total_claim_amount", "final_risk_score", "risk_level", "fraud_prediction", "triggered_rules"
    )


@query(
    "resolve_final_score",
    oracle(
        f"""{RULED}, candidates AS (SELECT row_idx,
  CASE WHEN row_idx % 3 = 0 THEN NULL ELSE risk_score * 2 - 50 END AS final_risk_score,
  CASE WHEN row_idx % 6 = 0 THEN NULL ELSE risk_score END AS risk_score,
  CASE WHEN row_idx % 12 = 0 THEN NULL ELSE CAST(row_idx % 150 AS DOUBLE) END AS combined_score FROM ruled)""",
        "SELECT row_idx, round(CASE WHEN coalesce(final_risk_score, risk_score, combined_score) IS NOT NULL THEN "
        "least(greatest(coalesce(final_risk_score, risk_score, combined_score), 0), 100) END, 6) AS final_score FROM candidates",
    ),
)
def resolve_final_score(spark, sf_dir):
    frame = ruled(spark, sf_dir).selectExpr(
        "row_idx",
        "CASE WHEN row_idx % 3 = 0 THEN 'n/a' ELSE CAST(risk_score * 2 - 50 AS STRING) END AS final_risk_score",
        "CASE WHEN row_idx % 6 = 0 THEN double('NaN') ELSE risk_score END AS risk_score",
        "CASE WHEN row_idx % 12 = 0 THEN double('Infinity') ELSE CAST(row_idx % 150 AS DOUBLE) END AS combined_score",
    )
    return frame.select("row_idx", fusion.resolve_final_score(frame).alias("final_score"))


@query(
    "next_step",
    oracle(
        SCORED,
        "SELECT row_idx, "
        + ", ".join(
            "CASE risk_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in steps.items()) + f" END AS {name}"
            for name, steps in (("batch_step", fusion.BATCH_STEPS), ("single_step", fusion.SINGLE_STEPS))
        )
        + " FROM scored",
    ),
)
def next_step(spark, sf_dir):
    level = F.col("risk_level")
    return scored(spark, sf_dir).select(
        "row_idx", fusion.next_step(level).alias("batch_step"), fusion.next_step(level, single=True).alias("single_step")
    )


@query(
    "triage_action",
    oracle(SCORED, "SELECT row_idx, CASE WHEN risk_score >= 70 THEN 'ESCALATE' WHEN risk_score >= 40 THEN 'VERIFY' ELSE 'APPROVE' END AS triage_action FROM scored"),
)
def triage_action(spark, sf_dir):
    return ruled(spark, sf_dir).select("row_idx", fusion.triage_action(F.col("risk_score")).alias("triage_action"))


def _by_level(pick):
    return "CASE risk_level " + " ".join(
        f"WHEN '{level}' THEN '{pick(fusion.ACTIONS[level.lower() + '_risk'])}'" for level in ("High", "Medium", "Low")
    ) + " END"


@query(
    "action_recommendation",
    oracle(
        SCORED,
        f"SELECT row_idx, {_by_level(lambda a: a[0])} AS action, {_by_level(lambda a: a[1])} AS description, "
        f"{_by_level(lambda a: ' | '.join(a[2]))} AS steps FROM scored",
    ),
)
def action_recommendation(spark, sf_dir):
    advice = fusion.action_recommendation(F.col("risk_level"))
    return scored(spark, sf_dir).select("row_idx", advice.alias("a")).select("row_idx", "a.action", "a.description", "a.steps")


# --- views -------------------------------------------------------------------
SHOWN = "row_idx, claim_id, round(final_risk_score, 6) AS final_risk_score, risk_level, fraud_prediction"
COLUMNS = ["row_idx", "claim_id", "final_risk_score", "risk_level", "fraud_prediction"]


@query("filter_by_band", oracle(SCORED, f"SELECT {SHOWN} FROM scored WHERE risk_level IN ('Medium', 'High')"))
def filter_by_band(spark, sf_dir):
    return views.filter_by_band(scored(spark, sf_dir), ["Medium", "High"]).select(*COLUMNS)


@query("filter_by_prediction", oracle(SCORED, f"SELECT {SHOWN} FROM scored WHERE fraud_prediction = 'Legitimate'"))
def filter_by_prediction(spark, sf_dir):
    return views.filter_by_prediction(scored(spark, sf_dir), "legit").select(*COLUMNS)


@query("sort_results", oracle(SCORED, f"SELECT {SHOWN} FROM scored ORDER BY final_risk_score DESC, claim_id"))
def sort_results(spark, sf_dir):
    return views.sort_results(scored(spark, sf_dir).select(*COLUMNS), "score_desc")


@query("preview", oracle(RAW, "SELECT row_idx, claim_id, total_claim_amount FROM claims_raw ORDER BY row_idx LIMIT 20"))
def preview(spark, sf_dir):
    return views.preview(claims_raw(spark, sf_dir).select("row_idx", "claim_id", "total_claim_amount"))


@query(
    "normalize_fraud_label",
    oracle(RAW, "SELECT row_idx, CASE lower(trim(fraud_reported)) WHEN 'yes' THEN 'Y' WHEN '0' THEN 'N' WHEN 'n' THEN 'N' END AS actual_fraud FROM claims_raw"),
)
def normalize_fraud_label(spark, sf_dir):
    raw = claims_raw(spark, sf_dir)
    label = views.find_label_column(raw.columns)
    return raw.select("row_idx", views.normalize_fraud_label(F.col(label)).alias("actual_fraud"))


@query(
    "binary_fraud_label",
    oracle(RAW, "SELECT row_idx, CAST(coalesce(upper(substr(trim(fraud_reported), 1, 1)) = 'Y', false) AS BIGINT) AS label FROM claims_raw"),
)
def binary_fraud_label(spark, sf_dir):
    raw = claims_raw(spark, sf_dir)
    letter = F.substring(F.trim("fraud_reported"), 1, 1)
    return raw.select("row_idx", views.binary_fraud_label(letter).alias("label"))


@query(
    "format_incident_hour",
    oracle(
        RAW,
        "SELECT row_idx, coalesce(ltrim(strftime(TIMESTAMP '2000-01-01' + to_hours(incident_hour_of_the_day), '%I %p'), '0'), '') AS short_text, "
        "coalesce(ltrim(strftime(TIMESTAMP '2000-01-01' + to_hours(incident_hour_of_the_day), '%I:%M %p'), '0'), '') AS long_text FROM claims_raw",
    ),
)
def format_incident_hour(spark, sf_dir):
    raw = claims_raw(spark, sf_dir)
    hour = "incident_hour_of_the_day"
    return raw.select(
        "row_idx",
        views.format_incident_hour(raw, hour).alias("short_text"),
        views.format_incident_hour(raw, hour, minutes=True).alias("long_text"),
    )


@query(
    "normalize_police_report",
    oracle(
        RAW,
        "SELECT row_idx, CASE police_report_available WHEN 'N' THEN 'NO' ELSE police_report_available END AS police_report FROM claims_raw",
    ),
)
def normalize_police_report(spark, sf_dir):
    return claims_raw(spark, sf_dir).select("row_idx", views.normalize_police_report(F.col("police_report_available")).alias("police_report"))
