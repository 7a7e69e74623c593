"""Every operator as a query over the driver tables, with its oracle SQL."""

from . import claims, learning, reports  # noqa: F401  (registration)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
