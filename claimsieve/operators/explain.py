"""Plain-language explanations built from native string expressions.

Where the wording has variants, the variant is picked by the claim id, so a claim
always reads the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed_text
from ..functions.text import lookup, stable_pick
from .runs import top_rules

# --- fixed values: opening sentence per band ---------------------------------
BAND_TEXTS = {
    "high_risk": [
        "This claim shows multiple red flags that are commonly associated with fraudulent activity.",
        "Several unusual patterns were detected that warrant further investigation.",
        "The claim exhibits characteristics that significantly deviate from normal patterns.",
    ],
    "medium_risk": [
        "This claim shows some concerning patterns that require additional verification.",
        "While not immediately suspicious, certain aspects of this claim need closer examination.",
        "Some indicators suggest this claim may need additional documentation or review.",
    ],
    "low_risk": [
        "This claim appears to follow normal patterns with minimal fraud indicators.",
        "The claim shows standard characteristics consistent with legitimate insurance claims.",
        "Most fraud detection checks passed with only minor concerns noted.",
    ],
}

# --- fixed values: texts per titled rule -------------------------------------
RULE_TEXTS = {
    "Z-Score Outlier": [
        "The claim amount is unusually high or low compared to similar cases",
        "Statistical analysis shows this amount is significantly different from the norm",
        "The claim value falls outside typical ranges for similar incidents",
    ],
    "Benford Anomaly": [
        "The claim amount doesn't follow natural number patterns",
        "The first digits of amounts in this claim are statistically unusual",
        "Number patterns suggest potential manipulation of claim values",
    ],
    "Unusual Hour": [
        "The incident occurred at a time when fraud is more commonly reported",
        "Late night or early morning incidents are flagged for additional review",
        "The timing of this incident matches patterns seen in fraudulent claims",
    ],
    "Round Amount": [
        "The claim amount is suspiciously round (like exactly ₱50,000)",
        "Legitimate claims rarely result in perfectly round numbers",
        "The precise amount suggests it may have been predetermined",
    ],
    "High Amount": [
        "The claim amount exceeds normal thresholds for this type of incident",
        "Large claims require additional scrutiny to prevent fraud",
        "The requested amount is significantly higher than typical cases",
    ],
    "Young High Claim": [
        "Young drivers with high-value claims require additional verification",
        "The combination of driver age and claim amount raises concerns",
        "Statistical data shows higher fraud rates in this demographic for large claims",
    ],
    "No Witnesses High": [
        "High-value claims without witnesses are more likely to be fraudulent",
        "The lack of independent verification for such a large claim is concerning",
        "Claims with no witnesses and high amounts need thorough investigation",
    ],
    "High Frequency": [
        "Multiple claims (>3) filed within 30 days indicates potential fraud pattern",
        "High frequency of claims from this policy is statistically suspicious",
        "Rapid succession of claims requires thorough investigation for coordination",
    ],
    "Duplicate Amount": [
        "Similar claim amounts were found in the same batch, suggesting coordination",
        "Multiple claims with identical amounts may indicate organized fraud",
        "The pattern of matching amounts across claims requires investigation",
    ],
}

#: Titles of the engine's rule names, used only with ``friendly=True``.
RULE_TITLES = {
    "z_score_outlier": "Z-Score Outlier",
    "benford_violation": "Benford Anomaly",
    "unusual_hour": "Unusual Hour",
    "very_suspicious_hour": "Unusual Hour",
    "round_amount": "Round Amount",
    "high_amount": "High Amount",
    "extreme_amount": "High Amount",
    "young_high_claim": "Young High Claim",
    "no_witnesses_high_claim": "No Witnesses High",
}

# --- fixed values: sentences of reasons, explanations and summaries ----------
NO_RULE_REASON = "Standard risk assessment based on claim characteristics"
NO_RULE_SECOND = "All standard verification checks completed"
ONE_RULE_SECOND = "Additional risk factors considered in overall assessment"
NOTHING_ANALYZED = "No claims were analyzed."
FIRST_FALLBACK, SECOND_FALLBACK = "Analysis detected: ", "Secondary concern: "
NO_RULE_TEXT = ("Rule: ", " - No detailed explanation available")
SCORE_OPENING = "The risk score of "
#: Sentence endings from a score on, highest first.
SCORE_ENDINGS = [
    (80, "/100 indicates very high fraud likelihood."), (60, "/100 suggests elevated fraud risk."), (30, "/100 indicates moderate concern."),
    (None, "/100 is within normal ranges."),
]
ONE_INDICATOR = "One fraud indicator was detected during analysis."
MANY_INDICATORS = " fraud indicators were detected during analysis."
#: Sentences above a probability, highest first.
MODEL_SENTENCES = [
    (0.7, "Machine learning models strongly suggest fraudulent activity."), (0.4, "Machine learning models indicate some concern."),
    (0, "Machine learning models support legitimate classification."),
]
SUMMARY_OPENING = ("Analyzed ", " claims with an average risk score of ", "/100.")
SUMMARY_BANDS = {"high": "require immediate investigation.", "medium": "need additional verification.", "low": "can proceed with standard processing."}
SUMMARY_SHARE = (" claims (", "%) ")
SUMMARY_INDICATORS = ("Most common fraud indicators: ", ".")

WHITESPACE = " \t\n\r\f\v"


def _clean_list(items: Column) -> Column:
    trimmed = F.transform(items, lambda r: F.btrim(r.cast("string"), F.lit(WHITESPACE)))
    return F.filter(trimmed, lambda r: r.isNotNull() & (r != ""))


def parse_rules(df: DataFrame) -> Column:
    """Clean array of rule names: ``top_indicators`` when it holds any, else ``triggered_rules`` split."""
    parts = []
    if "top_indicators" in df.columns:
        cleaned = _clean_list(F.col("top_indicators"))
        parts.append(F.when(F.size(cleaned) > 0, cleaned))
    if "triggered_rules" in df.columns:
        parts.append(_clean_list(F.split(F.col("triggered_rules"), ",")))
    return F.coalesce(*parts, F.array().cast("array<string>"))


def _rule_text(rule: Column, key: Column, fallback: Column, friendly: bool) -> Column:
    if friendly:
        rule = F.coalesce(lookup(RULE_TITLES, rule), rule)
    return F.coalesce(stable_pick(lookup(RULE_TEXTS, rule), key), fallback)


def reason_1(rules: Column, key: Column, friendly: bool = False) -> Column:
    first = F.try_element_at(rules, F.lit(1))
    fallback = F.concat(F.lit(FIRST_FALLBACK), F.lower(first))
    return F.when(F.size(rules) == 0, NO_RULE_REASON).otherwise(_rule_text(first, key, fallback, friendly))


def reason_2(rules: Column, key: Column, friendly: bool = False) -> Column:
    second = F.try_element_at(rules, F.lit(2))
    fallback = F.concat(F.lit(SECOND_FALLBACK), F.lower(second))
    return (
        F.when(F.size(rules) == 0, NO_RULE_SECOND)
        .when(F.size(rules) == 1, ONE_RULE_SECOND)
        .otherwise(_rule_text(second, key, fallback, friendly))
    )


def explain_rule(rule: Column, key: Column, friendly: bool = False) -> Column:
    """One of the texts of a rule, or a sentence saying there is none."""
    fallback = F.concat(F.lit(NO_RULE_TEXT[0]), rule, F.lit(NO_RULE_TEXT[1]))
    return _rule_text(rule, key, fallback, friendly)


def explanation_text(band: Column, score: Column, rules: Column, probability: Column | None, key: Column) -> Column:
    """Band sentence, score sentence, rule count sentence and model sentence."""
    known = F.coalesce(F.lower(band), F.lit("low"))
    known = F.when(known.isin("high", "medium"), known).otherwise("low")
    opening = stable_pick(lookup(BAND_TEXTS, F.concat(known, F.lit("_risk"))), key)
    shown = fixed_text(score, 2)
    ending = F.lit(SCORE_ENDINGS[-1][1])
    for least, words in reversed(SCORE_ENDINGS[:-1]):
        ending = F.when(score >= least, words).otherwise(ending)
    count = F.size(rules)
    counted = F.when(count == 1, F.lit(ONE_INDICATOR)).when(count > 1, F.concat(count.cast("string"), F.lit(MANY_INDICATORS)))
    parts = [opening, F.concat(F.lit(SCORE_OPENING), shown, ending), counted]
    if probability is not None:
        said = F.lit(None).cast("string")
        for above, words in reversed(MODEL_SENTENCES):
            said = F.when(probability > above, words).otherwise(said)
        parts.append(said)
    # concat_ws leaves out the sentences that do not apply (null).
    return F.concat_ws(" ", *parts)


def _first_present(df: DataFrame, names: tuple[str, ...]) -> Column | None:
    return next((F.col(n) for n in names if n in df.columns), None)


def add_explanations(df: DataFrame, friendly: bool = False, parsed: bool = False) -> DataFrame:
    """Add cleaned ``top_indicators``, ``reason_1``, ``reason_2``, ``explanation`` and ``triggered_rules``.

    ``parsed`` says that ``top_indicators`` is clean already, as the rule engine gives it.
    """
    if not parsed:
        df = df.withColumn("top_indicators", parse_rules(df))
    rules, key = F.col("top_indicators"), F.col("claim_id")
    band = _first_present(df, ("risk_band", "risk_level"))
    score = _first_present(df, ("final_risk_score", "risk_score"))
    probability = _first_present(df, ("ml_fraud_probability", "ml_fraud_prob"))
    return df.withColumns(
        {
            "reason_1": reason_1(rules, key, friendly),
            "reason_2": reason_2(rules, key, friendly),
            "explanation": explanation_text(
                F.coalesce(band, F.lit("Low")) if band is not None else F.lit("Low"),
                score if score is not None else F.lit(0.0),
                rules,
                probability,
                key,
            ),
            "triggered_rules": F.array_join(rules, ", "),
        }
    )


def summary_insights(scored: DataFrame, band: str = "risk_level", score: str = "final_risk_score") -> DataFrame:
    """One row: a text on volume, mean score, bands and the most common indicators."""
    total = F.col("n")
    counts = scored.agg(
        F.count("*").alias("n"),
        F.avg(score).alias("mean_score"),
        *[F.count_if(F.col(band) == b).alias(b.lower()) for b in ("High", "Medium", "Low")],
    )
    leading = (
        top_rules(scored, 3)
        .orderBy(F.desc("n"), "rule")
        .limit(2)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "rule"))).alias("r"))
        .select(F.array_join(F.transform("r", lambda r: r["rule"]), ", ").alias("names"))
        .scalar()
    )

    def share(column: str) -> Column:
        return fixed_text(F.try_divide(F.col(column), total) * 100, 1)

    def sentence(column: str) -> Column:
        opening, ending = SUMMARY_SHARE
        return F.concat(F.col(column).cast("string"), F.lit(opening), share(column), F.lit(ending + SUMMARY_BANDS[column]))

    start, middle, end = SUMMARY_OPENING
    text = F.concat_ws(
        " ",
        F.concat(F.lit(start), total.cast("string"), F.lit(middle), fixed_text(F.col("mean_score"), 1), F.lit(end)),
        F.when(F.col("high") > 0, sentence("high")),
        F.when(F.col("medium") > 0, sentence("medium")),
        sentence("low"),
        F.when(F.col("names") != "", F.concat(F.lit(SUMMARY_INDICATORS[0]), F.col("names"), F.lit(SUMMARY_INDICATORS[1]))),
    )
    return counts.withColumn("names", leading).select(
        F.when(total == 0, NOTHING_ANALYZED).otherwise(text).alias("insights")
    )
