"""Reading uploads and storing results and runs."""

from __future__ import annotations

import csv
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.runs import KEEP_RUNS
from ..schema import RESULT_SCHEMA, ROW_INDEX
from .records import RANGE_BYTES, number_ranges, read_records
from .run_store import RunStore


def _united(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def header_columns(line: str) -> list[str]:
    """Names in a header line; a repeated name gets its position appended."""
    names = next(csv.reader([line]), [])
    return [n if names.index(n) == i else f"{n}{i}" for i, n in enumerate(names)]


def read_claims_csv(spark: SparkSession, path: str, order_key: str | None = None, multi_line: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Header CSV with every column as text plus ``row_idx``; cleaning converts later.

    ``row_idx`` is the running number of a row over all files by path. It is settled when this function is called, for
    byte ranges of the files, so later settings or a changing number of executors can't move it. Files may
    have their columns in different orders or lack some, which are null then. ``multi_line`` allows line
    breaks in quoted values, wherever a range begins; every quote must then belong to a quoted value. Without
    it a quote left open at the end of a line is an error. ``order_key`` names a column
    that already holds the position.
    """
    ranges = number_ranges(spark, path, multi_line, range_bytes)
    if not multi_line:
        open_line = ranges.where("open_line IS NOT NULL").first()
        if open_line is not None:
            raise ValueError(f"a quoted value goes on in the next line, read with multi_line=True: {open_line['open_line'][:200]}")
    headers = [r["header"] for r in ranges.where("header IS NOT NULL").groupBy("header").agg(F.min("path").alias("path")).orderBy("path").collect()]
    if not headers:
        raise ValueError(f"no header line in {path}")
    frames, columns = [], {}
    for header in headers:
        names = header_columns(header)
        columns |= dict.fromkeys(names)
        schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
        records = read_records(ranges.where(F.col("header") == header), multi_line)
        parsed = F.from_csv("record", schema, {"escape": '"', "multiLine": str(multi_line).lower()})
        frames.append(records.select(parsed.alias("_row"), F.col("number").alias(ROW_INDEX)).select("_row.*", ROW_INDEX))
    united = _united(frames).select(*[F.col(f"`{c.replace('`', '``')}`") for c in columns], ROW_INDEX)
    if order_key is not None:
        return united.withColumn(ROW_INDEX, F.col(order_key).cast("bigint"))
    return united


def write_results_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_results_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def results_columns(scored: DataFrame) -> DataFrame:
    """The exported columns, in order."""
    return scored.select(*[F.col(f.name).cast(f.dataType) for f in RESULT_SCHEMA])


def write_results_csv(scored: DataFrame, path: str, mode: str = "errorifexists") -> None:
    results_columns(scored).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).option("header", True).option("escape", '"').csv(path)


def store_run(scored: DataFrame, path: str, run_id: str, runtime: float, timestamp: Column | None = None, on_repeat: str = "replace") -> None:
    """Store one run, results and record together; see :class:`RunStore`. A repeated call replaces the run, unless told otherwise."""
    RunStore(scored.sparkSession, path).store(scored, run_id, runtime, timestamp, on_repeat)


def read_runs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One record per stored run."""
    return RunStore(spark, path).runs(version)


def read_stored_results(spark: SparkSession, path: str, run_ids: list[str] | None = None, version: int | None = None) -> DataFrame:
    """Results of all stored runs, or of some."""
    return RunStore(spark, path).results(run_ids, version)


def retain_stored_runs(spark: SparkSession, path: str, keep: int = KEEP_RUNS) -> None:
    """Keep the newest stored runs only. Files stay until ``RunStore.vacuum``, for readers of an earlier version."""
    RunStore(spark, path).retain(keep)


def append_results(results: DataFrame, path: str, batch: str) -> None:
    """Add a batch of results. A repeated call with the same batch name replaces it."""
    RunStore(results.sparkSession, path).store(results, batch, 0.0)


def all_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of all batches, with their types as written."""
    return RunStore(spark, path).results().drop("run_id")
