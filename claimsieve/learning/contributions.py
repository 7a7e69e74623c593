"""Global feature importance and contributions of single claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import fixed_text
from ..functions.text import double, quoted

BASELINE = 0.5
TOP = 3


def normalized_text(feature: str) -> str:
    """SQL that scales a feature by the first name fragment that matches, in this order."""
    name, value = feature.lower(), f"CAST(`{feature}` AS DOUBLE)"
    # --- fixed values: centre and half-range per kind of feature -------------
    for fragments, centre, half in [
        (["age"], 49, 31),
        (["amount"], 250000, 250000),
        (["hour"], 11.5, 11.5),
        (["frequency", "count"], 2, 3),
    ]:
        if any(f in name for f in fragments):
            return f"(({value} - {centre}D) / {half}D)"
    return f"(CASE WHEN `{feature}` IS NOT NULL THEN least(greatest({value} / 100D, -1D), 1D) END)"


def normalize_feature_value(feature: str) -> Column:
    return F.expr(normalized_text(feature))


def title_name(feature: str) -> str:
    return " ".join(word.capitalize() for word in feature.replace("_", " ").split())


def contributions(df: DataFrame, importances: dict[str, float], probability: str = "probability") -> Column:
    """Array of ``feature, contribution`` sorted by size, built within the row: no unpivot, no shuffle."""
    types = {f.name: f.dataType for f in df.schema}
    parts = []
    for feature, importance in importances.items():
        if feature not in types:
            continue
        weighted = f"{double(importance)} * (`{probability}` - {BASELINE}D)"
        if isinstance(types[feature], T.NumericType):
            weighted = f"{double(importance)} * {normalized_text(feature)} * (`{probability}` - {BASELINE}D)"
        parts.append(f"named_struct('order', -abs({weighted}), 'feature', {quoted(feature)}, 'contribution', {weighted})")
    if not parts:
        return F.expr("CAST(array() AS array<struct<feature:string,contribution:double>>)")
    return F.expr(
        f"transform(array_sort(array({', '.join(parts)})), "
        "c -> named_struct('feature', c.feature, 'contribution', c.contribution))"
    )


def feature_contributions(df: DataFrame, importances: dict[str, float], key: str = "claim_id", probability: str = "probability") -> DataFrame:
    """Long form: one row per claim and feature."""
    return df.select(key, F.inline(contributions(df, importances, probability)))


def top_contributors(items: Column, positive: bool = True, n: int = TOP) -> Column:
    """First n contributions of one sign as ``feature`` (titled), ``contribution``, ``direction``."""
    chosen = F.slice(F.filter(items, lambda c: (c["contribution"] > 0) if positive else (c["contribution"] < 0)), 1, n)
    return F.transform(
        chosen,
        lambda c: F.struct(
            F.initcap(F.replace(c["feature"], F.lit("_"), F.lit(" "))).alias("feature"),
            c["contribution"].alias("contribution"),
            F.lit("increases" if positive else "decreases").alias("direction"),
        ),
    )


def explain_predictions(df: DataFrame, importances: dict[str, float], key: str = "claim_id", probability: str = "probability") -> DataFrame:
    """Add ``contributions``, ``top_positive``, ``top_negative`` and ``explanation_text``."""
    with_items = df.withColumn("contributions", contributions(df, importances, probability))
    with_tops = with_items.withColumns(
        {
            "top_positive": top_contributors(F.col("contributions"), True),
            "top_negative": top_contributors(F.col("contributions"), False),
        }
    )
    return with_tops.withColumn(
        "explanation_text",
        contribution_text(F.col(key), F.col(probability), F.col("top_positive"), F.col("top_negative")),
    )


# --- fixed values: sentences of a prediction's text --------------------------
#: More than 0.2 above the baseline, above it, more than 0.2 below, else.
DIRECTIONS = ["significantly higher than", "slightly higher than", "significantly lower than", "near"]
RISKS = ["elevated fraud risk", "moderate fraud risk", "low fraud risk", "neutral risk"]
OPENING = ("Claim ", " has a fraud probability of ", "%, which is ", " the baseline ({:.1%}), indicating ", ".")
BULLET, IMPACT = "  • ", " impact"
INCREASING, DECREASING = "Key factors increasing fraud likelihood:", "Key factors decreasing fraud likelihood:"


def contribution_text(key: Column, probability: Column, positive: Column, negative: Column) -> Column:
    """Multi-line text on a probability and its strongest contributors."""

    def words(options: list[str]) -> Column:
        much_more, more, much_less, near = options
        return (
            F.when(probability > BASELINE + 0.2, much_more)
            .when(probability > BASELINE, more)
            .when(probability < BASELINE - 0.2, much_less)
            .otherwise(near)
        )

    direction = words(DIRECTIONS)
    risk = words(RISKS)

    def bullets(items: Column, title: str, sign: str) -> Column:
        lines = F.transform(
            items,
            lambda c: F.concat(
                F.lit(BULLET), c["feature"], F.lit(f": {sign}"), fixed_text(F.abs(c["contribution"]), 3), F.lit(IMPACT)
            ),
        )
        return F.when(F.size(items) > 0, F.concat(F.lit(title + "\n"), F.array_join(lines, "\n")))

    claim, has, which, baseline, end = OPENING
    opening = F.concat(
        F.lit(claim), key, F.lit(has), fixed_text(probability * 100, 1), F.lit(which), direction, F.lit(baseline.format(BASELINE)), risk, F.lit(end)
    )
    return F.concat_ws(
        "\n\n",
        opening,
        bullets(positive, INCREASING, "+"),
        bullets(negative, DECREASING, "-"),
    )


def mean_importance(per_model: list[list[float]], features: list[str]) -> dict[str, float]:
    """Mean over models of importances that each sum to 1; uniform when no model has any."""
    shares = [[v / sum(m) for v in m] for m in per_model if sum(m) > 0]
    if not shares:
        return {f: 1.0 / len(features) for f in features}
    return {f: sum(s[i] for s in shares) / len(shares) for i, f in enumerate(features)}


def top_importance(importances: dict[str, float], n: int = 10) -> list[tuple[str, float]]:
    """Titled features by importance, largest first."""
    ranked = sorted(importances.items(), key=lambda kv: (-kv[1], kv[0]))[:n]
    return [(title_name(f), v) for f, v in ranked]
