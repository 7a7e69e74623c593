"""Small helpers the operators share: fresh column names, text batches, stable hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters handled per numpy step; bounds a task's memory whatever the length of a text.
BLOCK_CHARS = 1 << 18


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(spark: SparkSession) -> None:
    """Let Python workers take long texts in batches of a few megabytes; a setting of the session's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def id_remainder(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def text_blocks(texts: Iterable[str | None], size: int = BLOCK_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cut texts into blocks of about ``size`` characters.

    Yields (row of each piece, code points), where every piece is followed by one
    code point 0, so the pieces are found again. A text longer than a block is cut
    into several pieces. Code points 0 in a text become blanks.
    """
    rows: list[int] = []
    pieces: list[str] = []
    filled = 0

    def block() -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(pieces) + "\0"
        return np.asarray(rows), np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)

    for row, text in enumerate(texts):
        if not isinstance(text, str):
            continue
        text = text.replace("\0", " ")
        for start in range(0, max(1, len(text)), size):
            piece = text[start : start + size]
            if filled and filled + len(piece) > size:
                yield block()
                rows, pieces, filled = [], [], 0
            rows.append(row)
            pieces.append(piece)
            filled += len(piece) + 1
    if pieces:
        yield block()


def take_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: runs of anything but blank, tab, line feed, vertical tab, form feed, return."""
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
