"""Records of delimited text, found by byte range.

Files are cut into byte ranges of a fixed size, which have nothing to do with Spark's file splits. A first pass
counts for every range its quotes, and the records that begin in it: once as if the range began outside quotes,
once as if inside. The parity of all quotes before a range tells which of the two holds, and a running
sum over these counts numbers the records. A second pass reads the ranges again, each on its
own. So a record with line breaks in quotes may lie anywhere, one file is read by many tasks, and
the number of a record depends on the file alone.

A record ends at a line feed (a carriage return before it doesn't count) that stands outside quotes. Records of
nothing but blanks are left out, as is each file's header, its first record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .shared_files import open_file

#: Bytes of a range, of a read within it, and of a read for the end of a range's last record.
RANGE_BYTES = 1 << 26
PIECE_BYTES = 1 << 22
TAIL_BYTES = 1 << 16
#: Longest record; its end is looked for no further.
MOST_RECORD_BYTES = 1 << 28

QUOTE, LINE_FEED, RETURN, BLANK = ord('"'), ord("\n"), ord("\r"), ord(" ")
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def find_records(source, start: int, end: int, inside: bool, multi_line: bool) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Records that begin in a range: (bytes, begins, ends), some at a time.

    A record belongs to the range that holds the line feed before it, the first of a file to the first range. ``inside``
    tells whether the range begins within quotes.
    """
    size, at, odd = source.size(), start, int(inside)
    # Bytes of the record not yet ended; None if none has begun.
    held: bytearray | None = bytearray() if start == 0 else None
    while at < size and (at < end or held is not None):
        source.seek(at)
        piece = source.read(min(PIECE_BYTES, end - at) if at < end else TAIL_BYTES)
        data = np.frombuffer(piece, np.uint8)
        breaks = np.flatnonzero(data == LINE_FEED)
        if multi_line:
            quotes = data == QUOTE
            breaks = breaks[(np.cumsum(quotes)[breaks] + odd) % 2 == 0]
            odd = (odd + int(quotes.sum())) % 2
        if at >= end:
            breaks = breaks[:1]
        if not len(breaks):
            if held is not None:
                held += piece
                if len(held) > MOST_RECORD_BYTES:
                    raise ValueError(f"a record of more than {MOST_RECORD_BYTES} bytes begins before byte {at} of a file: is a quote left open?")
        else:
            begins, ends, whole = breaks[:-1] + 1, breaks[1:], piece
            if held is not None:
                whole, shift = bytes(held) + piece, len(held)
                begins, ends = np.concatenate([[0], begins + shift]), breaks + shift
            yield whole, begins, ends
            held = None if at >= end else bytearray(piece[breaks[-1] + 1 :])
        at += len(piece)
    if held:
        yield bytes(held), np.array([0]), np.array([len(held)])


def solid_records(source, start: int, end: int, inside: bool, multi_line: bool) -> Iterator[list[bytes]]:
    """The records of a range that hold more than blanks."""
    first = start == 0
    for whole, begins, ends in find_records(source, start, end, inside, multi_line):
        data = np.frombuffer(whole, np.uint8)
        solid = np.concatenate([[0], np.cumsum(data > BLANK)])
        full = solid[ends] > solid[begins]
        begins, ends = begins[full], ends[full]
        ends = ends - (data[ends - 1] == RETURN)
        records = [whole[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        if first and records:
            records[0], first = records[0].removeprefix(BYTE_ORDER_MARK), False
        yield records


class Tally:
    """Counts the records of a range while its bytes go by, for one state at its start."""

    def __init__(self, open_record: bool) -> None:
        self.rows, self.solid, self.open = 0, 0, open_record

    def add(self, solid: np.ndarray, breaks: np.ndarray) -> None:
        """``solid[i]`` is the number of bytes beyond blanks before place i of the piece."""
        at = solid[breaks]
        if len(at):
            self.rows += int((np.diff(at) > 0).sum()) + int(self.open and self.solid + at[0] > 0)
            self.open, self.solid = True, int(solid[-1] - at[-1])
        else:
            self.solid += int(solid[-1])

    def close(self, more: bool) -> int:
        """All records, with the last one, which goes on behind the range: ``more`` tells whether it has other bytes there."""
        return self.rows + int(self.open and (self.solid > 0 or more))


def solid_beyond(source, at: int) -> bool:
    """Whether the line from ``at`` on holds more than blanks."""
    size = source.size()
    while at < size:
        source.seek(at)
        data = np.frombuffer(source.read(TAIL_BYTES), np.uint8)
        told = np.flatnonzero((data > BLANK) | (data == LINE_FEED))
        if len(told):
            return bool(data[told[0]] != LINE_FEED)
        at += len(data)
    return False


def tally_range(source, start: int, end: int, multi_line: bool) -> tuple[int, int, int]:
    """Quotes in a range, and its records if it begins outside and inside quotes."""
    outside, within, total, at = Tally(start == 0), Tally(False), 0, start
    while at < end:
        source.seek(at)
        data = np.frombuffer(source.read(min(PIECE_BYTES, end - at)), np.uint8)
        if not len(data):
            break
        solid = np.concatenate([[0], np.cumsum(data > BLANK)])
        breaks, quotes = np.flatnonzero(data == LINE_FEED), data == QUOTE
        if multi_line:
            odd = (np.cumsum(quotes)[breaks] + total) % 2 == 1
            outside.add(solid, breaks[~odd])
            within.add(solid, breaks[odd])
        else:
            outside.add(solid, breaks)
        total += int(quotes.sum())
        at += len(data)
    # A record of blanks so far holds no quote, so the line feed that would end it stands outside quotes.
    more = solid_beyond(source, end)
    return total, outside.close(more), within.close(more)


def byte_ranges(spark: SparkSession, path: str | list[str], range_bytes: int) -> DataFrame:
    """(path, start, end) of all files; contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.filter("length > 0").select("path", "length", F.explode(starts).alias("start"))
    return ranges.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))


def spread(ranges: DataFrame) -> DataFrame:
    """A task for each range, if there aren't very many."""
    return ranges.repartition(max(1, min(ranges.count(), 10_000)))


def number_ranges(spark: SparkSession, path: str | list[str], multi_line: bool, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, end, inside, first, shift, header, open_line): ranges with the number of their first record over all files by path.

    ``header`` is the first record of the file, ``shift`` the number of the one after it; ``open_line`` is a line with an odd number of quotes,
    looked for unless ``multi_line``. Written as a table, so every later pass has the same ranges and numbers.
    """

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start, end in zip(batch["path"], batch["start"], batch["end"]):
                header = open_line = None
                with open_file(name) as source:
                    quotes, outside, within = tally_range(source, start, end, multi_line)
                    if start == 0:
                        header = next((r[0].decode("utf-8", "replace") for r in solid_records(source, 0, source.size(), False, multi_line) if r), None)
                    if not multi_line and quotes:
                        lines = (r for records in solid_records(source, start, end, False, False) for r in records)
                        open_line = next((r.decode("utf-8", "replace") for r in lines if r.count(b'"') % 2), None)
                yield pd.DataFrame({"path": [name], "start": [start], "end": [end], "quotes": [quotes], "outside": [outside], "within": [within], "header": [header], "open_line": [open_line]})

    ranges = stored(byte_ranges(spark, path, range_bytes), "byte-ranges")
    fields = "path string, start long, end long, quotes long, outside long, within long, header string, open_line string"
    counted = stored(spread(ranges).mapInPandas(tally, fields), "range-counts")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    inside = F.lit(multi_line) & (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    counted = counted.withColumn("inside", inside)
    counted = counted.withColumn("rows", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    counted = counted.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    # One row per file from here on.
    totals = counted.groupBy("path").agg(F.greatest(F.sum("rows") - 1, F.lit(0)).alias("rows"), F.max("header").alias("header"))
    earlier = W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("path", "header", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("shift"))
    placed = counted.drop("header").join(totals, "path")
    # The header is number shift - 1.
    return stored(placed.select("path", "start", "end", "inside", (F.col("first") + F.col("shift") - 1).alias("first"), "shift", "header", "open_line"), "numbered-ranges")


def read_records(ranges: DataFrame, multi_line: bool) -> DataFrame:
    """(record, number) of all records in ranges that :func:`number_ranges` gave, headers left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number = row["first"]
                with open_file(row["path"]) as source:
                    for records in solid_records(source, row["start"], row["end"], row["inside"], multi_line):
                        if records and number < row["shift"]:
                            records, number = records[1:], number + 1
                        texts = pa.array([r.decode("utf-8", "replace") for r in records], pa.string())
                        yield pa.RecordBatch.from_arrays([texts, pa.array(range(number, number + len(records)), pa.int64())], ["record", "number"])
                        number += len(records)

    return spread(ranges.select("path", "start", "end", "inside", "first", "shift")).mapInArrow(read, "record string, number long")
