"""Stratified, reproducible splitting by hash order.

Rows of a label are ordered by md5(key) and cut at given shares. Counting rows per
hash prefix finds the prefix each cut falls into; only that prefix is ranked. The
result is one cut hash per label and share, so assigning rows is a map-side
comparison and no label, however frequent, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 4


def hash_key(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def hash_cuts(df: DataFrame, label: str, key: str, shares: list[float]) -> DataFrame:
    """``label, cut_0, cut_1, …``: the floor(share·n)-th smallest hash, null when that is 0.

    A label none of whose cuts is above 0 has no row.
    """
    keyed = df.select(F.col(label), hash_key(key).alias("_h")).withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS))
    # Bounded: 16^PREFIX_DIGITS prefixes per label.
    sizes = keyed.groupBy(label, "_p").agg(F.count("*").alias("_c"))
    by_prefix = Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumns(
        {"_upto": F.sum("_c").over(by_prefix), "_n": F.sum("_c").over(Window.partitionBy(label))}
    )
    targets = F.array(
        *[F.struct(F.lit(i).alias("_i"), F.floor(F.lit(s) * F.col("_n")).alias("_t")) for i, s in enumerate(shares)]
    )
    wanted = (
        sizes.select(label, "_p", "_n", "_upto", "_c", F.inline(targets))
        .where((F.col("_t") <= F.col("_upto")) & (F.col("_t") > F.col("_upto") - F.col("_c")))
        .select(label, "_p", "_i", (F.col("_t") - (F.col("_upto") - F.col("_c"))).alias("_pos"))
    )
    ranked = keyed.join(F.broadcast(wanted), [label, "_p"]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(label, "_i", "_p").orderBy("_h"))
    )
    return ranked.where("_rn = _pos").groupBy(label).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_h"))).alias(f"cut_{i}") for i in range(len(shares))]
    )


def assign_blocks(df: DataFrame, label: str, key: str, shares: list[float], output: str) -> DataFrame:
    """Add ``output``: index of the hash block a row falls into, ``len(shares)`` past the last cut."""
    cuts = hash_cuts(df, label, key, shares)
    block = F.lit(len(shares))
    for i in reversed(range(len(shares))):
        block = F.when(hash_key(key) <= F.col(f"cut_{i}"), F.lit(i)).otherwise(block)
    return (
        df.join(F.broadcast(cuts), label, "left")
        .withColumn(output, block)
        .drop(*[f"cut_{i}" for i in range(len(shares))])
    )
