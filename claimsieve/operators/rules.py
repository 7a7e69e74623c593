"""The weighted rule catalog: one projection, no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schema as S
from ..functions.numbers import digit_text
from ..functions.text import literal, quoted, with_expressions

#: What a rule reads when the claim has no such field at all.
FIELD_DEFAULTS = {
    "total_claim_amount": 0.0,
    "incident_hour_of_the_day": 12.0,
    "age": 40.0,
    "witnesses": 1.0,
    "police_report_available": "YES",
    "incident_type": "",
    "incident_severity": "",
}

_NO_REPORT = "{police_report_available} IN ('NO', 'UNKNOWN', 'N')"
_SEVERE = "{incident_severity} IN ('Total Loss', 'Major Damage')"
_NIGHT = "{incident_hour_of_the_day} IN (1, 2, 3, 4)"
_LEADING = digit_text("{total_claim_amount}")

#: rule → condition over the claim fields, in evaluation order.
RULES = {
    "z_score_outlier": "{total_claim_amount} > 300000",
    "benford_violation": f"{{total_claim_amount}} >= 1 AND {_LEADING} IN (8, 9)",
    "very_suspicious_hour": _NIGHT,
    "unusual_hour": "{incident_hour_of_the_day} IN (0, 1, 2, 3, 4, 5, 22, 23) AND NOT " + _NIGHT,
    "round_amount": "{total_claim_amount} % 50000 = 0 OR ({total_claim_amount} % 10000 = 0 AND {total_claim_amount} >= 100000)",
    "extreme_amount": "{total_claim_amount} >= 250000",
    "high_amount": "{total_claim_amount} >= 150000 AND {total_claim_amount} < 250000",
    "young_high_claim": "{age} < 25 AND {total_claim_amount} >= 100000",
    "no_witnesses_high_claim": "{witnesses} = 0 AND {total_claim_amount} >= 150000",
    "no_police_report": _NO_REPORT,
    "theft_no_police": _NO_REPORT + " AND contains(lower({incident_type}), 'theft')",
    "total_loss_suspicious": _SEVERE,
    "severity_mismatch": _SEVERE + " AND {witnesses} = 0",
}


def rule_conditions(df: DataFrame) -> dict[str, str]:
    """SQL condition of every rule over the columns of ``df``; unknown is false."""
    have = set(df.columns)
    fields = {n: f"`{n}`" if n in have else literal(d) for n, d in FIELD_DEFAULTS.items()}
    return {name: f"coalesce({RULES[name].format(**fields)}, false)" for name in S.RULE_WEIGHTS}


def rule_flags(df: DataFrame, prefix: str = "rule_") -> DataFrame:
    """Add one 0/1 column per rule."""
    return with_expressions(df, {f"{prefix}{n}": f"CAST({c} AS INT)" for n, c in rule_conditions(df).items()})


def apply_rules(df: DataFrame) -> DataFrame:
    """Add ``top_indicators`` (ordered), ``triggered_rules``, ``combo_multiplier`` and ``risk_score``."""
    # Flags first: conditions are evaluated once and then referenced by name.
    fired = {n: f"_r_{n}" for n in S.RULE_WEIGHTS}
    flagged = with_expressions(df, {fired[n]: c for n, c in rule_conditions(df).items()})
    points = " + ".join(f"IF({fired[n]}, {w}, 0)" for n, w in S.RULE_WEIGHTS.items())
    names = ", ".join(f"IF({fired[n]}, {quoted(n)}, NULL)" for n in S.RULE_WEIGHTS)
    pairs = ", ".join(f"IF({fired[a]} AND {fired[b]}, {m}D, 1D)" for a, b, m in S.COMBO_MULTIPLIERS)
    scored = with_expressions(
        flagged,
        {
            "_indicators": f"array_compact(array({names}))",
            "_multiplier": f"greatest({pairs})",
            "_points": points,
        },
    )
    # The results leave through a one-row generator. Filters on them then stay above
    # this step; through plain projections the optimizer would push them down to the
    # scan with every rule expanded into them, several times over.
    made = ("_indicators", "_multiplier", "_points", *fired.values())
    kept = [f"`{c}`" for c in scored.columns if c not in made]
    return scored.selectExpr(
        *kept,
        "inline(array(named_struct('top_indicators', _indicators, 'combo_multiplier', _multiplier, "
        "'triggered_rules', array_join(_indicators, ', '), 'risk_score', least(_points * _multiplier, 100D))))",
    )
