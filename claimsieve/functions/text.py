"""SQL text helpers: one parsed expression instead of a tree of small calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double(value: float) -> str:
    """SQL double literal; without an exponent the number would be a decimal."""
    return f"{value:.17e}"


def literal(value) -> str:
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(literal(v) for v in value)})"
    if isinstance(value, float):
        return double(value)
    return str(value)


def map_literal(mapping: dict) -> str:
    """SQL map constant."""
    return f"map({', '.join(f'{literal(k)}, {literal(v)}' for k, v in mapping.items())})"


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a fixed mapping, null when the key is absent or null."""
    return F.try_element_at(F.expr(map_literal(mapping)), key)


def stable_pick(options: Column, key: Column) -> Column:
    """One element of an array, chosen by the first hex digit of md5(key): same key, same text."""
    digit = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 1), 16, 10).cast("int")
    return F.try_element_at(options, digit % F.size(options) + 1)


def with_expressions(df: DataFrame, new: dict[str, str]) -> DataFrame:
    """Add or replace columns given as SQL text; all of them see the columns of ``df``."""
    old = [f"{new[c]} AS `{c}`" if c in new else f"`{c}`" for c in df.columns]
    return df.selectExpr(*old, *[f"{sql} AS `{c}`" for c, sql in new.items() if c not in df.columns])
