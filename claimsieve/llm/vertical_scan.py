"""Hard negatives by a vertical scan (branch and bound on decomposed vectors).

Vectors are kept in blocks by column: all first components, then all second ones. For an anchor the columns are
read in descending magnitude of the anchor's components, some at a time. A candidate's score so far, plus
the least and the most that the columns still unread can add in this block, bounds its score; a candidate whose bounds
can't meet any window leaves the bitmap and isn't read any further. Windows are first
"the best n of the same label", and then, for each such positive, a range of scores of other labels.
Scores are integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .frames import col
from .vectors import dimension

#: Vectors per block, anchors per group, and columns read between two looks at the bounds.
BLOCK_ROWS = 8192
ANCHOR_ROWS = 512
COLUMNS = 8
#: Blocks that a task reads per group of anchors, about, and tasks of one meeting at most.
TASK_BLOCKS, MOST_TASKS = 16, 4096
#: Ends of a range without limit.
LEAST, MOST = -(1 << 62), 1 << 62


def largest_component(d: int) -> int:
    """Integer components beyond this count as this, so that 100 times an inner product fits 64 bits."""
    return int((2.0**55 / max(d, 1)) ** 0.5)


@dataclass
class Block:
    """Vectors by column: ``columns[j]`` has component j of all of them, sorted by label and id."""

    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray

    @cached_property
    def ends(self) -> np.ndarray:
        """Least and largest value of each column."""
        return np.stack([self.columns.min(axis=1), self.columns.max(axis=1)]).astype(np.int64)

    @cached_property
    def parts(self) -> dict[int, Block]:
        return {}

    def rows_of(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right")))

    def of_label(self, label: int) -> Block:
        if label not in self.parts:
            rows = self.rows_of(label)
            self.parts[label] = Block(self.ids[rows], self.labels[rows], self.columns[:, rows])
        return self.parts[label]


def scan(block: Block, anchor: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, step: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all candidates that can be among the first n of a window.

    Window i has the scores from low[i] to high[i]; ``alive`` is the bitmap of candidates to begin with.
    What is returned holds the n best of every window, ties included.
    """
    live, sums = np.flatnonzero(alive), np.zeros(int(alive.sum()), np.int64)
    if not len(live) or not len(low):
        return live[:0], sums[:0]
    order = np.argsort(-np.abs(anchor), kind="stable")
    reach = np.sort(block.ends[:, order] * anchor[order], axis=0)
    # least[r], most[r]: what the columns from place r on can add.
    least, most = np.pad(reach[:, ::-1].cumsum(axis=1)[:, ::-1], ((0, 0), (0, 1)))
    for read in range(0, len(order), step):
        chunk = order[read : read + step]
        for j in chunk:
            column = block.columns[j]
            sums += anchor[j] * (column if len(live) == len(column) else column[live]).astype(np.int64)
        rest = read + len(chunk)
        under, over = sums + least[rest], sums + most[rest]
        able = np.zeros(len(live), bool)
        for a, b in zip(low, high):
            # Of the candidates that are in the window whatever comes, the n-th best sets a floor.
            sure = under[(under >= a) & (over <= b)]
            floor = max(a, int(np.partition(sure, len(sure) - n)[len(sure) - n])) if len(sure) >= n else a
            able |= (over >= floor) & (under <= b)
        live, sums = live[able], sums[able]
        if not len(live):
            break
    return live, sums


def best_positives(block: Block, name: int, label: int, anchor: np.ndarray, n: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the n best of the anchor's label, ties to the smaller id."""
    own = block.of_label(label)
    places, scores = scan(own, anchor, own.ids != name, np.array([LEAST]), np.array([MOST]), n, step)
    order = np.lexsort((own.ids[places], -scores))[:n]
    return own.ids[places[order]], scores[order]


def window_of(positive: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores s with least * positive <= 100 * s <= most * positive."""
    return -((-least * positive) // 100), (most * positive) // 100


def best_negatives(block: Block, name: int, label: int, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, step: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(window, ids, scores): the n best of other labels in each window, ties to the smaller id."""
    alive = block.ids != name
    alive[block.rows_of(label)] = False
    open_windows = np.flatnonzero(low <= high)
    places, scores = scan(block, anchor, alive, low[open_windows], high[open_windows], n, step)
    order = np.lexsort((block.ids[places], -scores))
    places, scores = places[order], scores[order]
    found = []
    for i in open_windows:
        inside = np.flatnonzero((scores >= low[i]) & (scores <= high[i]))[:n]
        if len(inside):
            found.append((int(i), block.ids[places[inside]], scores[inside]))
    return found


def integer_vectors(vectors: DataFrame, label: Column, scale: int, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, label, vec): one row per id, components floor(scale * x); and their dimension."""
    d = dimension(vectors, vector)
    bound = float(largest_component(d))
    finite = F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.filter(col(key).isNotNull() & label.isNotNull() & col(vector).isNotNull() & (F.size(col(vector)) == d) & finite)
    # Clamped before the conversion: a double may be far beyond any integer type.
    whole = F.transform(col(vector), lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x.cast("double") * scale))).cast("long"))
    rows = good.select(col(key).cast("long").alias("id"), F.struct(label.cast("long").alias("label"), whole.alias("vec")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vec"), d


def pack_blocks(rows: DataFrame, d: int, blocks: int) -> DataFrame:
    """Blocks by column, written as a table: a row per block, in the narrowest integer type that fits."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["label", "id"])
        columns = np.array(part["vec"].tolist(), np.int64).reshape(len(part), d).T
        wide = int(np.abs(columns).max()) if columns.size else 0
        kind = "i2" if wide < 1 << 15 else "i4" if wide < 1 << 31 else "i8"
        return pd.DataFrame({
            "block": [int(key[0])], "ids": [part["id"].to_numpy(np.int64).tobytes()], "labels": [part["label"].to_numpy(np.int64).tobytes()],
            "kind": [kind], "columns": [np.ascontiguousarray(columns, kind).tobytes()],
        })

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return stored(dealt.groupBy("block").applyInPandas(pack, "block int, ids binary, labels binary, kind string, columns binary"), "columns")


def unpack_block(row, d: int) -> Block:
    return Block(np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64), np.frombuffer(row.columns, row.kind).reshape(d, -1))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding",
    positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256,
    block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, step: int = COLUMNS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of the integer vectors floor(scale * x). An anchor's positives are its best other rows
    of the same label; for each of them the best rows of other labels whose score is at least window[0] and at most
    window[1] percent of the positive's are listed. Ties go to the smaller id. Rows without id or label, and vectors
    that are null, of another length than most, or hold a null or non-finite component take no part. Of rows
    with one id only the first by label and vector counts. A component beyond ``largest_component`` counts as that.
    Groups of anchors meet blocks of vectors; no pair is a row. Either side is shuffled once and read by the tasks that need
    it: a join on the block would have to copy all groups for every block, through the driver where Spark broadcasts them.
    """
    rows, d = integer_vectors(vectors, label, scale, key, vector)
    chosen = vectors.filter(is_anchor).filter(col(key).isNotNull()).select(col(key).cast("long").alias("id")).distinct()
    rows = stored(rows, "integer-vectors")
    total = rows.count()
    numbers = max(1, -(-total // block_rows))
    blocks = pack_blocks(rows, d, numbers)
    anchors = stored(rows.join(chosen, "id", "left_semi"), "anchors")
    groups = max(1, -(-anchors.count() // anchor_rows))
    # Tasks with many blocks and few groups keep the best of an anchor together before the shuffle.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    block_parts = min(numbers, MOST_TASKS, max(-(-numbers // TASK_BLOCKS), -(-8 * cores // groups)))
    group_parts = min(groups, max(1, MOST_TASKS // block_parts))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = {"names": part["id"].to_numpy(np.int64), "own": part["label"].to_numpy(np.int64), "vecs": np.array(part["vec"].tolist(), np.int64)}
        if "ids" in part:
            found |= {"counts": part["ids"].map(len).to_numpy(np.int64), "ids": np.concatenate(list(part["ids"])), "scores": np.concatenate(list(part["scores"]))}
        return pd.DataFrame({"grp": [int(key[0])]} | {name: [np.ascontiguousarray(x, np.int64).tobytes()] for name, x in found.items()})

    def meet(asking: DataFrame, look, result: str) -> DataFrame:
        """``look`` at every block with every group of anchors."""
        fields = ["names", "own", "vecs", *(["counts", "ids", "scores"] if "ids" in asking.columns else [])]
        dealt = asking.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        packed = dealt.groupBy("grp").applyInPandas(pack, ", ".join(["grp int", *(f"{f} binary" for f in fields)]))
        packed = packed.withColumnsRenamed({"ids": "positive_ids"}).repartitionById(group_parts, F.pmod("grp", F.lit(group_parts)))
        spread = blocks.repartitionById(block_parts, F.pmod("block", F.lit(block_parts)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    yield look(unpack_block(row, d), row)

        return spread.hint("shuffle_replicate_nl").crossJoin(packed).mapInPandas(run, result)

    def each_anchor(row) -> Iterator[tuple[int, int, np.ndarray]]:
        names, own = np.frombuffer(row.names, np.int64), np.frombuffer(row.own, np.int64)
        return zip(names.tolist(), own.tolist(), np.frombuffer(row.vecs, np.int64).reshape(-1, d))

    def look_for_positives(block: Block, row) -> pd.DataFrame:
        found = []
        for name, own, anchor in each_anchor(row):
            ids, scores = best_positives(block, name, own, anchor, positives, step)
            found.append(pd.DataFrame({"id": name, "positive_id": ids, "score": scores}))
        return pd.concat(found)

    def look_for_negatives(block: Block, row) -> pd.DataFrame:
        found, ends = [], np.cumsum(np.frombuffer(row.counts, np.int64))
        ids, scores = np.frombuffer(row.positive_ids, np.int64), np.frombuffer(row.scores, np.int64)
        for (name, own, anchor), end, count in zip(each_anchor(row), ends, np.frombuffer(row.counts, np.int64)):
            asked = slice(end - count, end)
            low, high = window_of(scores[asked], *window)
            for i, places, sums in best_negatives(block, name, own, anchor, low, high, negatives, step):
                found.append(pd.DataFrame({"anchor_id": name, "positive_id": ids[asked][i], "positive_score": scores[asked][i], "negative_id": places, "negative_score": sums}))
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pd.concat(found) if found else pd.DataFrame({n: np.zeros(0, np.int64) for n in names})

    near = meet(anchors, look_for_positives, "id long, positive_id long, score long")
    by_score = W.partitionBy("id").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= positives)
    near = near.groupBy("id").agg(F.collect_list(F.struct("positive_id", "score")).alias("near"))
    asking = stored(anchors.join(near, "id").select("id", "label", "vec", F.col("near.positive_id").alias("ids"), F.col("near.score").alias("scores")), "positives")
    found = meet(asking, look_for_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    by_score = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
