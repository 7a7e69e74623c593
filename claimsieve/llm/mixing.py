"""Mixing sources to target weights by entropy balancing.

Of all document rates r that give each source its target number of words and use no
document more than ``most`` times, take those nearest to 1 in relative entropy. The
convex dual has one multiplier per source; its solution tilts the rates
exponentially in a document's words, r = min(most, exp(m * size / scale)). Newton's
method finds the multipliers. A step needs two sums per source, which Spark takes
over (source, size) cells with their number of documents, never over single documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .frames import col, fresh

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents rounded in one group; a large source is dealt over many groups.
GROUP_ROWS = 500
STEPS = 80
TOLERANCE = 1e-8
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but blank and the control characters 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """Targets of sources from (source, source_size): by weight, stopped at ``most`` times the size, the rest reshared.

    The stopped sources are those with the smallest size per weight, so one sort finds
    the level at which all words are shared out. One row per source is sorted in one task.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("sid", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(listed, ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    # A source without weight gets nothing and comes last, so it moves no level.
    ranked = ranked.withColumn("stop", F.when(F.col("weight") > 0, F.col("source_size") * F.lit(float(most))).otherwise(0.0))
    room = F.try_divide("stop", "weight")
    by_room = W.orderBy(room.asc_nulls_last(), "sid")
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", F.when(F.col("weight") > 0, F.try_divide(left, weight_left)))
    # The level is right at the first source that it doesn't fill; the formula goes wrong behind that.
    first_open = F.when(F.col("stop") > F.col("level") * F.col("weight"), F.struct(room.alias("room"), "sid", "level"))
    ranked = ranked.withColumn("level", F.min(first_open).over(everything)["level"])
    return ranked.withColumn("target", F.least("stop", F.coalesce(F.col("level") * F.col("weight"), F.col("stop")))).drop("level", "stop")


def balance(cells: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """Multiplier ``m`` per source from (sid, size, n) cells: Newton steps, kept inside a shrinking bracket.

    The sums are of exact decimals, so their order, and with it a rerun, can't change a digit.
    """
    step = sources.filter("target > 0").selectExpr(
        "sid", "target", "scale",
        # A source that gives all it may is solved by the multiplier that takes its smallest document to the limit.
        f"IF(target >= {most}D * source_size * (1 - 1e-12D), ln({most}D) * scale / least_size, 0D) AS m", f"ln({most}D) * scale / least_size AS high",
        "least(0D, ln(target / source_size)) * scale / least_size AS low",
    )
    step = stored(step, "mix-step")
    rate = f"least({most}D, exp(m * size / scale))"
    slope = f"CASE WHEN exp(m * size / scale) < {most}D THEN exp(m * size / scale) * size / scale ELSE 0D END"
    for _ in range(STEPS):
        exact = "sum(CAST(n * size * ({}) AS DECIMAL(38, 12)))"
        sums = cells.join(step, "sid").groupBy("sid").agg(
            F.expr(exact.format(rate)).cast("double").alias("got"), F.expr(exact.format(slope)).cast("double").alias("slope")
        )
        moved = step.join(sums, "sid").selectExpr(
            "sid", "target", "scale", "m", "got - target AS gap", "IF(got < target, m, low) AS low", "IF(got > target, m, high) AS high", "slope"
        )
        moved = moved.withColumn("newton", F.expr("IF(slope > 0, m - gap / slope, NULL)"))
        moved = moved.selectExpr(
            "sid", "target", "scale", "gap", "low", "high",
            f"CASE WHEN abs(gap) <= {TOLERANCE} * target THEN m WHEN newton > low AND newton < high THEN newton ELSE (low + high) / 2 END AS m",
        )
        step = stored(moved, "mix-step")
        worst = step.agg(F.max(F.expr("IF(high - low <= 1e-13 * (abs(low) + abs(high)), 0D, abs(gap) / target)"))).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return step.select("sid", F.round("m", 10).alias("m"))


def round_group(docs: pd.DataFrame, most: int) -> pd.DataFrame:
    """Copies of each document: the rate rounded up or down, whichever keeps the words taken so far nearer to those wanted.

    Large documents come first, so what they miss or exceed is made up by the small ones.
    """
    docs = docs.sort_values(["size", "text_hash", "id"], ascending=[False, True, True], na_position="last", kind="stable")
    owed, copies = 0.0, np.zeros(len(docs), np.int64)
    for i, (size, rows, rate) in enumerate(zip(docs["size"], docs["alike"], docs["rate"])):
        words, low = size * rows, int(np.floor(rate))
        owed += words * (rate - low)
        up = low < min(rate, most) and owed >= words / 2
        owed -= words * up
        copies[i] = low + up
    return docs.assign(copies=copies)


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: int = 2, weights: tuple[float, ...] = WEIGHTS
) -> DataFrame:
    """One row per row of ``docs``: (id, text_hash, size, source_size, target, rate, copies).

    Sources in code point order, null last, have the ``weights`` in turn and share ``share``
    times all words; a weight of 0 gives a target of 0. No target is above ``most`` times its source's words. Documents without
    words have rate 1. Rows alike in id, text and source are used equally often. An empty
    table gives no rows. Only id, text and source are read; the result is the same in every run.
    """
    rows = docs.select(
        col(key).alias("id"), F.xxhash64(col(text).cast("string")).alias("text_hash"), col(source).cast("string").alias("source"), word_count(col(text)).alias("size")
    )
    rows = stored(rows.groupBy("id", "text_hash", "source", "size").agg(F.count("*").alias("alike")), "mix-rows")
    sums = rows.groupBy("source").agg(
        F.sum(F.expr("size * alike")).alias("source_size"), F.sum("alike").alias("docs"), F.min(F.expr("IF(size > 0, size, NULL)")).alias("least_size")
    )
    sources = source_targets(sums, share, most, weights).withColumn("scale", F.expr("source_size / docs"))
    sources = stored(sources, "mix-sources")
    known = sources.select(F.col("source").alias("source_name"), "sid", "source_size", "target", "scale", "docs")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("source_name")))
    cells = stored(placed.filter("size > 0").groupBy("sid", "size").agg(F.sum("alike").alias("n")), "mix-cells")
    multipliers = balance(cells, sources, float(most))
    rated = placed.join(multipliers, "sid", "left").selectExpr(
        "id", "text_hash", "size", "alike", "sid", "source_size", "target",
        # A source without multiplier has a target of 0.
        f"CASE WHEN size = 0 THEN 1D WHEN m IS NULL THEN 0D ELSE least({float(most)}D, exp(m * size / scale)) END AS rate",
        f"pmod(xxhash64(text_hash, id), greatest(1L, CAST(ceil(docs / {GROUP_ROWS}) AS BIGINT))) AS bucket",
    )
    names = [f.name for f in rated.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rated.schema.fields) + ", copies long"
    rounded = rated.groupBy("sid", "bucket").applyInPandas(lambda group: round_group(group, most)[names + ["copies"]], schema)
    return rounded.selectExpr("id", "text_hash", "size", "source_size", "target", "rate", "copies", "explode(sequence(1L, alike)) AS nth").drop("nth")


def take_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_sources` says; columns stay as they are."""
    mixed = mix_sources(docs, key, text, source, **settings)
    chosen = stored(mixed.filter("copies > 0").select("id", "text_hash", "copies").distinct(), "mix-copies")
    times, name = fresh(docs, "copies"), fresh(docs, "nth")
    chosen = chosen.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("copies").alias(times)).alias("_mix")
    same = col(key).eqNullSafe(F.col("_mix._id")) & (F.xxhash64(col(text).cast("string")) == F.col("_mix._hash"))
    joined = docs.join(chosen, same).select(*[col(c) for c in docs.columns], col(times))
    return joined.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[col(c) for c in docs.columns])
