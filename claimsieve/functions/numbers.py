"""Numeric column helpers shared by the operators."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import quoted


def number_text(name: str, dtype: T.DataType | None = None) -> str:
    """SQL double of a column; text that is no number, NaN and infinities become null.

    Spark orders NaN above every number, so a NaN that slipped through would
    satisfy each ``>`` rule.
    """
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return f"CAST(`{name}` AS DOUBLE)"
    value = f"`{name}`"
    if dtype is None or isinstance(dtype, T.StringType):
        # Java accepts a type suffix ("5d"), which is not a number here.
        value = f"try_cast(regexp_replace(CAST({value} AS STRING), '[dDfF][ \\t]*$', '?') AS DOUBLE)"
    elif not isinstance(dtype, T.DoubleType):
        value = f"try_cast({value} AS DOUBLE)"
    return f"IF(abs({value}) <= {sys.float_info.max!r}D, {value}, NULL)"


def clean_number(name: str, dtype: T.DataType | None = None) -> Column:
    return F.expr(number_text(name, dtype))


def clipped_text(sql: str, low: float, high: float) -> str:
    """Limit to a range; null stays null (``least``/``greatest`` alone would skip it)."""
    return f"CASE WHEN {sql} IS NOT NULL THEN least(greatest({sql}, {low}D), {high}D) END"


def flag_text(condition: str) -> str:
    """0/1 integer; an unknown condition counts as 0."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def digit_text(amount: str) -> str:
    """First character of the decimal text of a positive amount, as an integer.

    Fixed notation covers 0.0001 and up, so amounts from there to 1 start with 0.
    """
    return (
        f"CASE WHEN {amount} < 1 AND {amount} >= 0.0001D THEN 0 "
        f"ELSE try_cast(substring(CAST({amount} AS STRING), 1, 1) AS INT) END"
    )


def bin_text(value: str, bins: list[tuple[float | None, str]], low: float) -> str:
    """Label of the first bin whose upper bound is not below ``value``."""
    cases = [f"WHEN {value} <= {low} THEN CAST(NULL AS STRING)"]
    for upper, name in bins:
        cases.append(f"WHEN {value} {'IS NOT NULL' if upper is None else f'<= {upper}'} THEN {quoted(name)}")
    return f"CASE {' '.join(cases)} END"


def round_half_even(value: Column, places: int) -> Column:
    """Round to ``places`` decimals, exact halves to the even digit (as text formatting does)."""
    scale = float(10**places)
    return F.rint(value * scale) / scale


def fixed_text(value: Column, places: int) -> Column:
    """Text of ``value`` with a fixed number of decimals."""
    return F.format_string(f"%.{places}f", round_half_even(value, places))
