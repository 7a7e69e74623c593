"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of a vector, form a product grid of cells. Each
vector is stored in the cell of its nearest two centroids and visits the cells
nearest to it in the order of a multi-sequence traversal, that is by the sum of both squared
distances. How many cells are visited comes from a sample whose links are known
from comparing it with all vectors; where it has few, also from partners placed at the threshold. Within a cell all visitors are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import connected_components
from .frames import col
from .vectors import dimension, matrix, unit, usable

#: Vectors the codebooks are fitted on, and sample vectors for the number of visited cells.
FIT_ROWS = 20_000
SAMPLE_ROWS = 400
#: Linked sample vectors from which their links alone set the number of visited cells; placed partners per sample vector.
ENOUGH_LINKED = 400
PARTNERS = 8
#: Vectors per cell aimed at; visited cells considered at first, and twice as many while the recall isn't reached; vectors per block of a crowded cell.
CELL_ROWS = 64
FIRST_CELLS = 128
BLOCK_ROWS = 2048


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    visits: int = FIRST_CELLS

    def ranked(self, rows: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` nearest cells of each row, nearest first; ties to the smaller cell.

        The n-th nearest cell of a grid is among the pairs of places (i, j) with (i + 1)(j + 1) <= n in the two
        sorted lists, so only those sums are formed.
        """
        half = self.first.shape[1]
        lists = []
        for part, book in ((rows[:, :half], self.first), (rows[:, half:], self.second)):
            far = (part**2).sum(axis=1, keepdims=True) - 2 * part @ book.T + (book**2).sum(axis=1)
            order = np.argsort(far, axis=1, kind="stable")[:, :visits]
            lists.append((order, np.take_along_axis(far, order, axis=1)))
        (one, far_one), (two, far_two) = lists
        pairs = [(i, j) for i in range(one.shape[1]) for j in range(two.shape[1]) if (i + 1) * (j + 1) <= visits]
        i, j = np.array(pairs).T
        cells = one[:, i].astype(np.int64) * len(self.second) + two[:, j]
        near = np.lexsort((cells, far_one[:, i] + far_two[:, j]), axis=1)[:, :visits]
        return np.take_along_axis(cells, near, axis=1)


def codebook(rows: np.ndarray, size: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of rows by k-means, started from distinct random rows."""
    rows = np.unique(rows, axis=0)
    size = max(1, min(size, len(rows)))
    book = rows[np.random.default_rng(seed).permutation(len(rows))[:size]].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmin((book**2).sum(axis=1) - 2 * rows[a : a + 4096] @ book.T, axis=1) for a in range(0, len(rows), 4096)])
        sums, counts = np.zeros_like(book), np.bincount(near, minlength=size)
        np.add.at(sums, near, rows)
        book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return book


def hashed_share(nodes: DataFrame, rows: int, total: int, seed: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by hash."""
    part = min(1.0, rows / max(total, 1))
    return nodes.filter(F.pmod(F.xxhash64(F.lit(seed), "h1"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30))))


def placed_partners(sample: np.ndarray, threshold: float, count: int, seed: int = 9) -> np.ndarray:
    """``count`` unit vectors per row of ``sample``, row after row, at a cosine of ``threshold`` in random directions."""
    near = np.repeat(sample, count, axis=0)
    aside = np.random.default_rng(seed).standard_normal(near.shape)
    aside -= (aside * near).sum(axis=1, keepdims=True) * near
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = float(np.clip(threshold, -1, 1))
    placed = cosine * near + (1 - cosine**2) ** 0.5 * aside / np.maximum(length, 1e-300)
    return np.where(length > 1e-9, placed, near)


def link_ranks(cells: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Place of the first visit that brings both ends of a link together, either way; the number of visits for none."""
    there, here, none = cells == back[:, :1], back == cells[:, :1], cells.shape[1]
    return np.minimum(np.where(there.any(axis=1), there.argmax(axis=1), none), np.where(here.any(axis=1), here.argmax(axis=1), none))


def enough_visits(counts: np.ndarray, recall: float) -> int | None:
    """Visits that reach the recall over all links and on average over vectors; None if these many don't.

    ``counts`` has the number of links by (vector, rank), those not found in the last column.
    """
    counts = counts[counts.sum(axis=1) > 0]
    overall = counts.sum(axis=0).cumsum() / counts.sum()
    each = (counts.cumsum(axis=1) / counts.sum(axis=1, keepdims=True)).mean(axis=0)
    enough = np.flatnonzero((overall >= recall) & (each >= recall))
    return int(enough[0]) + 1 if len(enough) and enough[0] < counts.shape[1] - 1 else None


def fit_index(nodes: DataFrame, total: int, d: int, threshold: float, recall: float) -> MultiIndex:
    """Codebooks from about FIT_ROWS vectors; visited cells from about SAMPLE_ROWS compared with all vectors.

    A link counts as found if either vector visits the other's cell. The recall must
    hold over all links of the sample and on average over its vectors. If fewer than ENOUGH_LINKED
    sample vectors have links, it must also hold for partners placed at the threshold.
    """
    rows = unit(matrix(hashed_share(nodes, FIT_ROWS, total, 1).select("vec").toPandas()["vec"], d))
    if not len(rows):
        rows = unit(np.ones((1, max(d, 1))))
    size = int(np.clip(round((total / CELL_ROWS) ** 0.5), 2, max(2, len(rows) // 8)))
    half = max(1, d // 2)
    index = MultiIndex(codebook(rows[:, :half], size), codebook(rows[:, half:], size) if d > 1 else np.zeros((1, 0)))
    picked = hashed_share(nodes, SAMPLE_ROWS, total, 2).select("node", "vec").toPandas()
    if picked.empty:
        return index
    sample, names = unit(matrix(picked["vec"], d)), picked["node"].to_numpy()
    grid, cells = len(index.first) * len(index.second), FIRST_CELLS
    while True:
        cells = min(cells, grid)
        visits = visits_needed(nodes, index, sample, names, d, threshold, recall, cells)
        if visits is not None or cells == grid:
            # Visiting the whole grid compares all vectors with all.
            index.visits = visits or grid
            return index
        cells *= 2


def visits_needed(nodes: DataFrame, index: MultiIndex, sample: np.ndarray, names: np.ndarray, d: int, threshold: float, recall: float, cells: int) -> int | None:
    """Visits, of at most ``cells``, that reach the recall for the sample; None if more are needed."""
    order = index.ranked(sample, cells)
    shared = nodes.sparkSession.sparkContext.broadcast((index, sample, names, order))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, probes, own, visited = shared.value
        for batch in batches:
            every, nodes_here = unit(matrix(batch["vec"], d)), batch["node"].to_numpy()
            s, v = np.nonzero((probes @ every.T >= threshold) & (own[:, None] != nodes_here[None, :]))
            if not len(s):
                continue
            linked, place = np.unique(v, return_inverse=True)
            back = book.ranked(every[linked], cells)
            rank = link_ranks(visited[s], back[place])
            yield pd.DataFrame({"s": s, "rank": rank, "n": 1}).groupby(["s", "rank"], as_index=False).sum()

    found = nodes.select("node", "vec").mapInPandas(compare, "s long, rank long, n long").groupBy("s", "rank").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(sample), cells + 1))
    np.add.at(counts, (found["s"].to_numpy(int), found["rank"].to_numpy(int)), found["n"].to_numpy(float))
    linked = int((counts.sum(axis=1) > 0).sum())
    needed = [enough_visits(counts, recall) if linked else 1]
    if linked < ENOUGH_LINKED:
        s = np.repeat(np.arange(len(sample)), PARTNERS)
        placed = np.zeros_like(counts)
        np.add.at(placed, (s, link_ranks(order[s], index.ranked(placed_partners(sample, threshold, PARTNERS), cells))), 1)
        needed.append(enough_visits(placed, recall))
    return None if None in needed else max(needed)


def local_components(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label per row and column of a linked matrix, columns numbered before rows."""
    cols = np.arange(linked.shape[1])
    rows = np.full(linked.shape[0], linked.shape[1])
    while True:
        rows_now = np.where(linked, cols[None, :], len(cols)).min(axis=1)
        cols_now = np.minimum(cols, np.where(linked, rows_now[:, None], len(cols)).min(axis=0))
        if (rows_now == rows).all() and (cols_now == cols).all():
            return rows, cols
        rows, cols = rows_now, cols_now


def compare_cell(block: pd.DataFrame, d: int, threshold: float) -> pd.DataFrame:
    """Visitors of a cell against the vectors stored in it: links counted on both sides, and links enough to connect them.

    A stored vector that doesn't visit its visitor's cell gets its count here, since that pair meets nowhere else.
    """
    stored_here, visitors = block[block["at_home"]], block[~block["at_home"]]
    empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    if stored_here.empty or visitors.empty:
        return empty
    linked = unit(matrix(visitors["vec"], d)) @ unit(matrix(stored_here["vec"], d)).T >= threshold
    here, there = stored_here["node"].to_numpy(), visitors["node"].to_numpy()
    linked &= there[:, None] != here[None, :]
    if not linked.any():
        return empty
    copies_here, copies_there = stored_here["copies"].to_numpy(), visitors["copies"].to_numpy()
    p, h = np.nonzero(linked)
    visited = np.array([np.asarray(v, np.int64) for v in stored_here["visits"]])
    homes = visitors["home"].to_numpy()
    counts = np.zeros(len(here), np.int64)
    for a in range(0, len(p), 1 << 16):
        pa, ha = p[a : a + (1 << 16)], h[a : a + (1 << 16)]
        alone = ~(visited[ha] == homes[pa][:, None]).any(axis=1)
        np.add.at(counts, ha[alone], copies_there[pa[alone]])
    out = [pd.DataFrame({"a": there, "b": -1, "n": linked @ copies_here}), pd.DataFrame({"a": here, "b": -1, "n": counts})]
    rows, cols = local_components(linked)
    ties = [(there[i], here[c]) for i, c in enumerate(rows) if c < len(here)] + [(here[i], here[c]) for i, c in enumerate(cols) if c != i]
    out.append(pd.DataFrame(ties, columns=["a", "b"]).assign(n=0))
    result = pd.concat(out)
    return result[(result["b"] >= 0) | (result["n"] > 0)].astype(np.int64)


def similar_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.995) -> DataFrame:
    """One row per row of ``rows``: (key, n_links, component_id, kept).

    Links are found pairs of vectors with a cosine of at least ``threshold`` in double precision; none is below.
    ``n_links`` counts other rows linked directly, copies included; ``component_id`` is the
    smallest id reachable. Vectors that are null, zero, of another length than most, or hold a null or
    non-finite component link with nothing, even their own copies. Equal vectors are
    compared once. A null id is no component's id unless there is no other. Other columns are not read.
    """
    d = dimension(rows, vector)
    base = rows.select(col(key).alias("id"), col(vector).alias("vec"))
    good = base.filter(usable(F.col("vec"), d)).select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(11), "vec").alias("h2"))
    nodes = good.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.count("*").alias("copies"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    total = nodes.count()
    index = fit_index(nodes, total, d, threshold, recall)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("array<long>")
    def cells_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for vectors in batches:
            yield pd.Series(list(known.ranked(unit(matrix(vectors, d)), known.visits))) if len(vectors) else pd.Series([], dtype=object)

    placed = nodes.select("node", "vec", "copies", cells_of("vec").alias("visits")).withColumn("home", F.element_at("visits", 1))
    placed = stored(placed, "placed-vectors")
    homes = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("stored"))
    visits = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("visited"))
    crowded = homes.join(visits, "cell").filter((F.col("stored") > BLOCK_ROWS) | (F.col("visited") > BLOCK_ROWS))
    blocks = stored(crowded.selectExpr("cell", f"CAST(ceil(stored / {BLOCK_ROWS}) AS INT) AS m", f"CAST(ceil(visited / {BLOCK_ROWS}) AS INT) AS n"), "crowded-cells")
    at_home = placed.selectExpr("home AS cell", "node", "vec", "copies", "home", "visits", "true AS at_home").join(blocks, "cell", "left")
    at_home = at_home.selectExpr("*", "pmod(xxhash64(node), coalesce(m, 1)) AS x", "explode(sequence(0, coalesce(n, 1) - 1)) AS y")
    visiting = placed.selectExpr("explode(visits) AS cell", "node", "vec", "copies", "home", "CAST(NULL AS ARRAY<BIGINT>) AS visits", "false AS at_home")
    visiting = visiting.join(blocks, "cell", "left")
    visiting = visiting.selectExpr("*", "explode(sequence(0, coalesce(m, 1) - 1)) AS x", "pmod(xxhash64(node), coalesce(n, 1)) AS y")
    columns = ["cell", "CAST(x AS INT) AS x", "CAST(y AS INT) AS y", "node", "vec", "copies", "home", "visits", "at_home"]
    meeting = at_home.selectExpr(*columns).unionByName(visiting.selectExpr(*columns))
    found = meeting.groupBy("cell", "x", "y").applyInPandas(lambda block: compare_cell(block, d, threshold), "a long, b long, n long")
    found = stored(found, "vector-links")

    counts = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = connected_components(found.filter("b >= 0").select("a", "b")).select("node", "component")
    rooted = nodes.join(roots, "node", "left").join(counts, "node", "left")
    rooted = stored(rooted.selectExpr("h1", "h2", "least", "copies - 1 + coalesce(linked, 0) AS n_links", "coalesce(component, node) AS root"), "rooted-vectors")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("h1", "h2", "n_links", "component_id")
    linked = good.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "n_links", "component_id")
    apart = base.filter(~usable(F.col("vec"), d)).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = linked.unionByName(apart).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return result.select(F.col("id").alias(key), "n_links", "component_id", "kept")
