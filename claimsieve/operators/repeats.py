"""Ids that occur in several runs, found through a Bloom filter per run.

A filter has BITS_PER_ID bits per distinct id and PROBES probes, so about one id in 1,000 that isn't in a run seems to be. Rows whose id no
other run's filter knows are dropped where they are read. Only the rest is shuffled, and counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ID, PROBES = 16, 6
#: Smallest and largest filter in bits. Beyond the largest more ids seem to repeat; the counts stay exact.
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 27
#: Chance that an id that isn't in a run of full size seems to be, by the usual estimate.
FALSE_POSITIVES = (1 - np.exp(-PROBES / BITS_PER_ID)) ** PROBES


def bits_for(ids: int) -> int:
    """Bits of a filter for so many distinct ids: a power of two."""
    return int(min(MOST_BITS, max(LEAST_BITS, 1 << max(0, BITS_PER_ID * ids - 1).bit_length())))


def id_hashes(key: Column) -> list[Column]:
    """Two hashes of an id; all probes follow from them."""
    text = key.cast("string")
    return [F.xxhash64(F.lit(5), text).alias("h1"), F.xxhash64(F.lit(6), text).alias("h2")]


def probes(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """(ids, PROBES) bits of a filter."""
    first, step = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64) | np.uint64(1)
    return (first[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def known(filters: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each id may be in the filter (bytes, eight bits each)."""
    at = probes(h1, h2, 8 * len(filters))
    return ((filters[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build_filter(ids: DataFrame, key: str, bits: int) -> DataFrame:
    """One row (filter): the ids' Bloom filter. Tasks fill filters of their own, which are merged in two steps."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = probes(batch["h1"].to_numpy(), batch["h2"].to_numpy(), bits).ravel()
            np.bitwise_or.at(marks, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pd.DataFrame({"filter": [marks.tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for marks in batch["filter"]:
                total |= np.frombuffer(marks, np.uint8)
        yield pd.DataFrame({"filter": [total.tobytes()]})

    hashes = ids.where(F.col(key).isNotNull()).select(*id_hashes(F.col(key)))
    return hashes.coalesce(64).mapInPandas(fill, "filter binary").coalesce(8).mapInPandas(merge, "filter binary").coalesce(1).mapInPandas(merge, "filter binary")


def possible_repeats(rows: DataFrame, filters: dict[str, bytes], key: str = "claim_id", run: str = "run_id") -> DataFrame:
    """The (run, id) rows whose id may be in a run other than their own.

    ``filters`` has a run's filter each, of at most MOST_BITS, and goes to every executor.
    """
    names = list(filters)
    shared = rows.sparkSession.sparkContext.broadcast((names, [np.frombuffer(f, np.uint8) for f in filters.values()]))

    @F.pandas_udf("boolean")
    def elsewhere(runs: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.Series:
        found = np.zeros(len(runs), bool)
        one, two, own = h1.to_numpy(), h2.to_numpy(), runs.to_numpy()
        for name, filled in zip(*shared.value):
            asked = np.flatnonzero(~found & (own != name))
            found[asked] = known(filled, one[asked], two[asked])
        return pd.Series(found)

    narrow = rows.where(F.col(key).isNotNull()).select(F.col(run).alias("run_id"), F.col(key).cast("string").alias("claim_id"))
    return narrow.where(elsewhere("run_id", *id_hashes(F.col("claim_id"))))


def ids_of_several_runs(rows: DataFrame, filters: dict[str, bytes], key: str = "claim_id", run: str = "run_id") -> DataFrame:
    """(claim_id, runs, n): ids in more than one run, with the number of runs and rows. Exact."""
    candidates = possible_repeats(rows, filters, key, run).groupBy("claim_id", "run_id").agg(F.count("*").alias("n"))
    return candidates.groupBy("claim_id").agg(F.count("*").alias("runs"), F.sum("n").alias("n")).where(F.col("runs") > 1)
