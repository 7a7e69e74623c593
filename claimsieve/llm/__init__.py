"""Operators for preparing training data, each written for tables far larger than one machine."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
