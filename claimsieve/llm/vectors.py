"""Vectors as columns: which take part, and as bytes for numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import col


def dimension(rows: DataFrame, vector: str) -> int:
    """The commonest length of a vector, the larger one of equals; 0 without vectors."""
    lengths = rows.filter(col(vector).isNotNull()).groupBy(F.size(col(vector)).alias("d")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def usable(vector: Column, d: int) -> Column:
    """Vectors of dimension d with finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == d) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors, d: int) -> np.ndarray:
    """Rows of doubles from a pandas column of arrays."""
    return np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), d)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, however large or small their components."""
    if not rows.size:
        return rows
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def lengths(rows: np.ndarray) -> np.ndarray:
    """Length of each row without an overflow on the way."""
    if not rows.size:
        return np.zeros(len(rows))
    scale = np.abs(rows).max(axis=1)
    return np.linalg.norm(rows / scale[:, None], axis=1) * scale
