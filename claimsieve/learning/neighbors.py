"""Exact k-nearest-neighbour join by Euclidean distance.

Two ways with equal results:

* The reference side fits a byte limit (it is counted first): it is broadcast and
  each task compares its query batches with it. No shuffle.
* Otherwise an index deals it to Voronoi cells of about as many pivots as the root of its rows, and neighbouring cells to shelves of
  about BLOCK_ROWS rows. A query visits the shelf of the least lower bound first, and then every shelf whose bound is not beyond
  its k-th distance so far. Bounds come from the triangle inequality, the bisector to the nearest pivot, and the cell's box on
  the principal axes of a sample with the range of what the axes leave over. Shelves are cut into blocks of reference rows and
  the queries of a shelf into chunks, packed rows of a few megabytes, so a crowded cell becomes many tasks. Chunks and
  blocks are shuffled a fixed number of times; tasks then read the pairs that a bound leaves, which is never written. The index can
  be saved and used again.

Copies of one vector are reduced to the ids that can possibly be chosen before any
search. Tasks emit at most k rows per query and block, never all pairs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, stored

BROADCAST_BYTES = 32 * 1024 * 1024
#: Cells of the partitioned way: about the root of the reference rows, so cells and their size grow alike.
MIN_PIVOTS, MAX_PIVOTS = 16, 4096
#: Rows that pivots and axes are fitted on, about, and rounds of moving the pivots to their cells' means.
FIT_ROWS, FIT_ROUNDS = 32_768, 4
#: Principal axes with a box per cell.
AXES = 16
#: Reference rows compared at a time.
TILE_ROWS = 16384
BLOCK_ROWS = 16384
CHUNK_ROWS = 16384
#: Bytes of vectors in a block or chunk at most, blocks that a task holds, and tasks of one search at most.
PACK_BYTES, TASK_BLOCKS, MOST_TASKS = 4 << 20, 8, 4096
#: Cells of one distance matrix, which keeps it near 16 MB, and of one matrix of bounds, of which there are about ten at a time.
MATRIX_CELLS, BOUND_CELLS = 2_000_000, 500_000
#: Pairs whose exact distance is taken at a time.
EXACT_PAIRS = 65_536
SLACK = 1e-9
ROUNDING = 1e-7

OUT = "q_id bigint, t_id bigint, distance double"
CHUNK = "shelf int, chunk int, ids binary, vecs binary, kth binary, need binary, wanted array<int>, visits bigint, found_q binary, found_t binary, found_d binary"


def nearest_in_block(q_ids, q, t_ids, t, k: int, exclude_self: bool, reach: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest rows of ``t`` per row of ``q``; equal distances go to the smaller id.

    A matrix product shortlists rows, then exact differences decide. Rows beyond ``reach``, a distance
    per row of ``q``, may be left out.
    """
    found = []
    t_norm = np.einsum("ij,ij->i", t, t)
    step = max(1, MATRIX_CELLS // max(1, len(t)))
    for start in range(0, len(q), step):
        part, ids = q[start : start + step], q_ids[start : start + step]
        part_norm = np.einsum("ij,ij->i", part, part)
        square = part_norm[:, None] + t_norm[None, :] - 2.0 * (part @ t.T)
        if exclude_self and np.isin(ids, t_ids).any():
            square[ids[:, None] == t_ids[None, :]] = np.inf
        keep = min(k, len(t))
        tolerance = SLACK * (part_norm + t_norm.max() + 1.0)
        limit = None if reach is None else reach[start : start + step] ** 2
        if limit is None or (square <= (limit + tolerance)[:, None]).sum() > 4 * k * len(part):
            limit = np.partition(square, keep - 1, axis=1)[:, keep - 1]
        rows, cols = np.nonzero(square <= (limit + tolerance)[:, None])
        usable = np.isfinite(square[rows, cols])
        rows, cols = rows[usable], cols[usable]
        slices = [slice(a, a + EXACT_PAIRS) for a in range(0, max(len(rows), 1), EXACT_PAIRS)]
        exact = np.concatenate([np.sqrt(((part[rows[a]] - t[cols[a]]) ** 2).sum(axis=1)) for a in slices])
        order = np.lexsort((t_ids[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        opens = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
        position = np.arange(len(rows)) - np.maximum.accumulate(np.where(opens, np.arange(len(rows)), 0))
        best = position < k
        found.append(pd.DataFrame({"q_id": ids[rows[best]], "t_id": t_ids[cols[best]], "distance": exact[best]}))
    return pd.concat(found, ignore_index=True) if found else _nothing()


def nearest_in_tiles(q_ids, q, t_ids, t, k: int, exclude_self: bool) -> pd.DataFrame:
    """:func:`nearest_in_block` over any number of reference rows, TILE_ROWS at a time; query ids are unique."""
    parts = [
        nearest_in_block(q_ids, q, t_ids[a : a + TILE_ROWS], t[a : a + TILE_ROWS], k, exclude_self) for a in range(0, max(len(t), 1), TILE_ROWS)
    ]
    if len(parts) == 1:
        return parts[0]
    return pd.concat(parts).sort_values(["q_id", "distance", "t_id"]).groupby("q_id").head(k)


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in vectors])


def _side(df: DataFrame, id_column: str, vector: str, prefix: str) -> DataFrame:
    return df.select(
        F.col(id_column).cast("bigint").alias(f"{prefix}_id"), F.col(vector).cast("array<double>").alias(f"{prefix}_vec")
    ).where(F.col(f"{prefix}_vec").isNotNull())


def _smallest(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """First k rows per key. Spark applies the limit before the shuffle as well."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", position).where(F.col("_rn") <= k).drop("_rn")


def knn_join(
    queries: DataFrame,
    reference: DataFrame | NeighborIndex,
    k: int,
    id_column: str = "id",
    vector: str = "features",
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    pivots: int | None = None,
) -> DataFrame:
    """``q_id, t_id, distance, rank`` of the k nearest reference rows of each query.

    ``exclude_self`` skips the reference row with the query's own id. Ids are
    integers, unique per side. Ties go to the smaller reference id. ``reference`` may be an index built before.
    """
    if isinstance(reference, NeighborIndex):
        found = reference.search(_side(queries, id_column, vector, "q"), k, exclude_self)
        return _ranked(found, k)
    queries, reference = _side(queries, id_column, vector, "q"), _side(reference, id_column, vector, "t")
    size = _size(reference)
    # Of identical vectors only the k smallest ids can be among the k nearest (one
    # more when the query itself may be one of them).
    reference = _smallest(reference, ["t_vec"], ["t_id"], k + int(exclude_self))
    if not _fits(size, broadcast_bytes):
        # Read several times, unless copies were all that was too much.
        reference = stored(reference, "knn-reference")
        size = _size(reference)
    if not size["n"]:
        return queries.sparkSession.createDataFrame([], OUT + ", rank int")
    if _fits(size, broadcast_bytes):
        found = _search_broadcast(queries, reference, k, exclude_self)
    else:
        found = build_index(reference, k + int(exclude_self), pivots, size["n"]).search(queries, k, exclude_self)
    return _ranked(found, k)


def _fits(size, broadcast_bytes: int) -> bool:
    return size["n"] * ((size["d"] or 0) * 8 + 8) <= broadcast_bytes


def _size(reference: DataFrame):
    return reference.agg(F.count("*").alias("n"), F.max(F.size("t_vec")).alias("d")).first()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "t_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search_broadcast(queries: DataFrame, reference: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    # The caller has checked that this stays below the byte limit.
    table = reference.toPandas()
    shared = queries.sparkSession.sparkContext.broadcast((table["t_id"].to_numpy("int64"), _matrix(table["t_vec"])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t_ids, t = shared.value
        for batch in batches:
            if len(batch):
                yield nearest_in_tiles(batch["q_id"].to_numpy("int64"), _matrix(batch["q_vec"]), t_ids, t, k, exclude_self)

    # A given number, so that few rows of much work aren't put into one task.
    return queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "q_id").mapInPandas(search, OUT)


def _pivot_distances(vectors, pivots: np.ndarray) -> np.ndarray:
    x = _matrix(vectors)
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def _nearest_pivot(vectors, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance to its pivot) per row, some rows at a time: a batch against all pivots would grow with the pivots."""
    rows, cell, away = max(1, BOUND_CELLS // len(pivots)), np.empty(len(vectors), "int32"), np.empty(len(vectors))
    for start in range(0, len(vectors), rows):
        part = slice(start, start + rows)
        d = _pivot_distances(vectors[part], pivots)
        cell[part], away[part] = d.argmin(axis=1), d.min(axis=1)
    return cell, away


@dataclass
class NeighborIndex:
    """Reference rows in cells, with what bounds the distance of a query to each cell.

    ``cells`` has (t_id, t_vec, cell); the arrays have a row per cell and are bounded by MAX_PIVOTS. Shelves follow from them. Of
    identical vectors the ``copies`` smallest ids are kept, so k (and one more without the query itself) may be as many.
    """

    cells: DataFrame
    pivots: np.ndarray
    size: np.ndarray
    far: np.ndarray
    near: np.ndarray
    centre: np.ndarray
    axes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    copies: int
    path: str
    #: (query, shelf) pairs that the last search visited: first shelves, and all others.
    visits: list[int] = field(default_factory=list)

    def lower_bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, cells): what no row of a cell can be nearer than, and the distances to the pivots."""
        d = _pivot_distances(x, self.pivots)
        closest = d.argmin(axis=1)
        between = _pivot_distances(self.pivots[closest], self.pivots)
        with np.errstate(divide="ignore", invalid="ignore"):
            bisector = (d**2 - (d[np.arange(len(d)), closest] ** 2)[:, None]) / (2.0 * between)
        bisector = np.where(np.isfinite(bisector), bisector, 0.0)
        box = np.zeros_like(d)
        for axis, place in enumerate(_on_axes(x, self.centre, self.axes).T):
            gap = np.maximum(self.low[None, :, axis] - place[:, None], place[:, None] - self.high[None, :, axis])
            box += np.maximum(gap, 0.0) ** 2
        lower = np.maximum.reduce([d - self.far, self.near - d, bisector, np.sqrt(box)])
        return np.where(self.size > 0, lower, np.inf), d

    def shelves(self) -> np.ndarray:
        """The shelf of each cell, -1 where it is empty: halves of the cells along their widest axis, down to BLOCK_ROWS rows or one cell."""
        shelf, count = np.full(len(self.size), -1), 0
        todo = [np.flatnonzero(self.size > 0)]
        while todo:
            part = todo.pop()
            if len(part) < 2 or self.size[part].sum() <= BLOCK_ROWS:
                shelf[part] = count
                count += len(part) > 0
                continue
            part = part[np.argsort(self.pivots[part, self.pivots[part].var(axis=0).argmax()], kind="stable")]
            filled = np.cumsum(self.size[part])
            cut = int(np.clip(np.searchsorted(filled, filled[-1] / 2), 1, len(part) - 1))
            todo += [part[cut:], part[:cut]]
        return shelf

    def search(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """(q_id, t_id, distance): at least the k nearest of each row of ``queries`` (q_id, q_vec)."""
        if k + int(exclude_self) > self.copies:
            raise ValueError(f"the index keeps {self.copies} copies of a vector, too few for {k} neighbours")
        self.visits.clear()
        shelf = self.shelves()
        count = int(shelf.max(initial=-1)) + 1
        if not count:
            return queries.sparkSession.createDataFrame([], OUT)
        by_shelf = np.argsort(shelf, kind="stable")[(shelf < 0).sum() :]
        opens = np.searchsorted(shelf[by_shelf], np.arange(count))
        rows_of = np.bincount(shelf[by_shelf], weights=self.size[by_shelf], minlength=count)
        # Distances come from a matrix product, which is off by about the root of a double's precision near 0.
        slack = ROUNDING * (1.0 + float(np.abs(self.far[np.isfinite(self.far)]).max(initial=0.0)) + float(np.abs(self.pivots).max(initial=0.0)))
        index, fit = self._without_frame(), max(1, PACK_BYTES // (8 * self.pivots.shape[1]))
        blocks_of = np.array([max(1, -(-int(n) // min(BLOCK_ROWS, fit))) for n in rows_of])
        number_of = np.cumsum(blocks_of) - blocks_of  # of a shelf's first block

        def shelf_bounds(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
            """Lower bounds and pivot distances by shelf, some rows at a time."""
            rows = max(1, BOUND_CELLS // len(index.pivots))
            for start in range(0, len(x), rows):
                part = slice(start, start + rows)
                yield part, *(np.minimum.reduceat(m[:, by_shelf], opens, axis=1) for m in index.lower_bounds(x[part]))

        def first_shelf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    firsts = [np.lexsort((d, lower), axis=1)[:, 0] for _, lower, d in shelf_bounds(_matrix(batch["q_vec"]))]
                    yield batch.assign(shelf=np.concatenate(firsts).astype("int32"))

        asked = stored(queries.select("q_id", "q_vec").mapInPandas(first_shelf, "q_id bigint, q_vec array<double>, shelf int"), "knn-asked")
        per_shelf = {r["shelf"]: r["n"] for r in asked.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
        self.visits.append(sum(per_shelf.values()))
        if not per_shelf:
            return queries.sparkSession.createDataFrame([], OUT)
        chunks = [-(-per_shelf.get(s, 0) // min(CHUNK_ROWS, fit)) for s in range(count)]

        def begin(key: tuple, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            """A chunk of queries, what its first block has for them, and the blocks that are left to visit."""
            if not len(q):
                return pd.DataFrame({n: [] for n in CHUNK.replace(",", "").split()[::2]})
            home, ids, x = int(key[0]), q["q_id"].to_numpy("int64"), _matrix(q["q_vec"])
            found = nearest_in_block(ids, x, t["t_id"].to_numpy("int64"), _matrix(t["t_vec"]), k, exclude_self) if len(t) else _nothing()
            kth = _kth(ids, found, k)
            need = np.concatenate([lower <= (kth[part] + slack)[:, None] for part, lower, _ in shelf_bounds(x)])
            wanted = [n for s in np.flatnonzero(need.any(axis=0)) for n in range(number_of[s], number_of[s] + blocks_of[s]) if n != number_of[home]]
            need[:, home] &= blocks_of[home] > 1
            return pd.DataFrame({
                "shelf": [home], "chunk": [int(key[1])], "ids": [ids.tobytes()], "vecs": [x.tobytes()], "kth": [kth.tobytes()], "need": [np.packbits(need, axis=1).tobytes()],
                "wanted": [wanted], "visits": [int(need.sum() - need[:, home].sum())],
                "found_q": [found["q_id"].to_numpy("int64").tobytes()], "found_t": [found["t_id"].to_numpy("int64").tobytes()], "found_d": [found["distance"].to_numpy("float64").tobytes()],
            })

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    yield pd.DataFrame({"q_id": np.frombuffer(row.found_q, "int64"), "t_id": np.frombuffer(row.found_t, "int64"), "distance": np.frombuffer(row.found_d)})

        def pack(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"number": [int(number_of[key[0]] + key[1])], "t_shelf": [int(key[0])], "t_ids": [t["t_id"].to_numpy("int64").tobytes()], "t_vecs": [_matrix(t["t_vec"]).tobytes()]})

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Chunks with blocks, all of a chunk together; the k-th distances shrink from block to block."""
            name, kth, found = None, None, []
            for batch in batches:
                for row in batch.itertuples(index=False):
                    if name != (row.shelf, row.chunk):
                        if found:
                            yield _nearest_of(found, k)
                        name, kth, found = (row.shelf, row.chunk), np.frombuffer(row.kth).copy(), []
                    ids, t_ids = np.frombuffer(row.ids, "int64"), np.frombuffer(row.t_ids, "int64")
                    need = np.frombuffer(row.need, "uint8").reshape(len(ids), -1)[:, row.t_shelf // 8] >> (7 - row.t_shelf % 8) & 1
                    asking = np.flatnonzero(need)
                    x, t = np.frombuffer(row.vecs).reshape(len(ids), -1)[asking], np.frombuffer(row.t_vecs).reshape(len(t_ids), -1)
                    more = nearest_in_block(ids[asking], x, t_ids, t, k, exclude_self, kth[asking] if np.isfinite(kth[asking]).all() else None)
                    kth[asking] = np.minimum(kth[asking], _kth(ids[asking], more, k))
                    found.append(more)
            if found:
                yield _nearest_of(found, k)

        n_blocks, n_chunks = (F.element_at(F.array(*[F.lit(int(n)) for n in list_]), F.col("shelf") + 1) for list_ in (blocks_of, chunks))
        cells = self.cells.select("t_id", "t_vec", F.element_at(F.array(*[F.lit(int(s)) for s in shelf]), F.col("cell") + 1).alias("shelf"))
        cells = cells.withColumn("block", F.pmod(F.xxhash64("t_id"), n_blocks).cast("int"))
        left = asked.withColumn("chunk", F.pmod(F.xxhash64("q_id"), n_chunks).cast("int"))
        right = cells.where((F.col("block") == 0) & F.col("shelf").isin(list(per_shelf))).drop("block").withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
        # Groups are much work for little data, so a given number of tasks keeps them apart where sizes would merge them.
        keys, tasks = ["shelf", "chunk"], min(4 * sum(chunks), MOST_TASKS)
        begun = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(begin, CHUNK)
        begun = stored(begun, "knn-begun")
        best = begun.select("found_q", "found_t", "found_d").mapInPandas(unpack, OUT)
        self.visits.append(begun.agg(F.sum("visits")).first()[0] or 0)
        wanted = [r["n"] for r in begun.select(F.explode("wanted").alias("n")).distinct().collect()]  # numbers of blocks
        if wanted:
            shelves = set((np.searchsorted(number_of, wanted, "right") - 1).tolist())
            block_parts = -(-int(blocks_of[list(shelves)].sum()) // TASK_BLOCKS)
            chunk_parts = min(sum(chunks), max(1, MOST_TASKS // block_parts))
            chosen = cells if len(shelves) == count else cells.where(F.col("shelf").isin(list(shelves)))
            tasks = min(4 * int(blocks_of.sum()), MOST_TASKS)
            blocks = chosen.repartition(tasks, "shelf", "block").groupBy("shelf", "block").applyInPandas(pack, "number int, t_shelf int, t_ids binary, t_vecs binary")
            blocks = blocks.repartitionById(block_parts, F.pmod("number", F.lit(block_parts)))
            # Chunks are numbered one after the other.
            number = F.element_at(F.array(*[F.lit(int(n)) for n in np.cumsum(chunks) - chunks]), F.col("shelf") + 1) + F.col("chunk")
            waiting = begun.where(F.size("wanted") > 0).select("shelf", "chunk", "ids", "vecs", "kth", "need", "wanted")
            waiting = waiting.repartitionById(chunk_parts, F.pmod(number, F.lit(chunk_parts)))
            pairs = waiting.hint("shuffle_replicate_nl").join(blocks, F.array_contains("wanted", F.col("number"))).drop("wanted", "number")
            best = best.unionByName(pairs.mapInPandas(visit, OUT))
        return stored(_smallest(best, ["q_id"], ["distance", "t_id"], k), "knn-best")

    def _without_frame(self) -> NeighborIndex:
        """The arrays alone, as tasks get them."""
        return NeighborIndex(None, self.pivots, self.size, self.far, self.near, self.centre, self.axes, self.low, self.high, self.copies, self.path)

    def save(self, path: str) -> None:
        """Store the index below ``path``; :func:`load_index` needs no pass over the rows."""
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")
        arrays = {n: getattr(self, n) for n in ("pivots", "size", "far", "near", "centre", "axes", "low", "high")}
        rows = [(n, list(a.shape), bytearray(np.ascontiguousarray(a, float).tobytes())) for n, a in arrays.items()]
        rows.append(("facts", [], bytearray(json.dumps({"copies": self.copies}).encode())))
        self.cells.sparkSession.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def load_index(spark: SparkSession, path: str) -> NeighborIndex:
    rows = {r["name"]: r for r in spark.read.parquet(f"{path}/bounds").collect()}
    copies = json.loads(bytes(rows.pop("facts")["data"]))["copies"]
    arrays = {n: np.frombuffer(bytes(r["data"])).reshape(r["shape"]) for n, r in rows.items()}
    return NeighborIndex(spark.read.parquet(f"{path}/cells"), **arrays, copies=copies, path=path)


def index_rows(reference: DataFrame, copies: int = 8, id_column: str = "id", vector: str = "features", pivots: int | None = None) -> NeighborIndex:
    """An index over a frame, for searches of up to ``copies`` neighbours (one less where a query leaves itself out)."""
    rows = stored(_smallest(_side(reference, id_column, vector, "t"), ["t_vec"], ["t_id"], copies), "knn-reference")
    return build_index(rows, copies, pivots, rows.count())


def _on_axes(x: np.ndarray, centre: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Places on the axes, and the length of what they leave over."""
    away = x - centre
    places = away @ axes.T
    rest = np.sqrt(np.maximum((away * away).sum(axis=1) - (places * places).sum(axis=1), 0.0))
    return np.column_stack([places, rest])


def _lowest_hashes(rows: DataFrame, wanted: int, total: int) -> list:
    """The ``wanted`` distinct vectors of lowest hash. Rows of higher hash are left out before the tasks' shares meet at the driver."""
    hashed = rows.select("t_vec", F.xxhash64("t_vec").alias("_hash")).distinct()
    share = min(1.0, 1.25 * wanted / max(total, 1))
    while True:
        low = hashed if share == 1.0 else hashed.where(F.col("_hash") < F.lit(int(share * (1 << 64)) - (1 << 63)))
        chosen = low.orderBy("_hash").limit(wanted).select("t_vec").collect()
        if len(chosen) == wanted or share == 1.0:
            return [r["t_vec"] for r in chosen]
        share = min(1.0, 4 * share)


def build_index(rows: DataFrame, copies: int, pivots: int | None, total: int) -> NeighborIndex:
    """Deal stored (t_id, t_vec) rows to cells. Pivots and axes come from a sample of bounded size, chosen by hash."""
    spark = rows.sparkSession
    count = min(max(pivots or round(total**0.5), 1 if pivots else MIN_PIVOTS), MAX_PIVOTS)
    chosen = _lowest_hashes(rows, max(FIT_ROWS, count), total)
    sample = _matrix(chosen) if chosen else np.zeros((1, 1))
    book = sample[:count].copy()
    for _ in range(FIT_ROUNDS):
        own = _nearest_pivot(sample, book)[0]
        sums, n = np.zeros_like(book), np.bincount(own, minlength=len(book))
        np.add.at(sums, own, sample)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    centre = sample.mean(axis=0)
    axes = np.linalg.svd(sample - centre, full_matrices=False)[2][:AXES]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["t_vec"])
                cell, away = _nearest_pivot(x, book)
                yield batch.assign(cell=cell, to_pivot=away, places=list(_on_axes(x, centre, axes)))

    path = scratch_path(spark, "knn-index")
    placed = rows.mapInPandas(place, "t_id bigint, t_vec array<double>, cell int, to_pivot double, places array<double>")
    placed.write.parquet(f"{path}/cells")
    placed = spark.read.parquet(f"{path}/cells")
    ends = [f(F.col("places")[i]).alias(f"{name}{i}") for i in range(len(axes) + 1) for name, f in (("low", F.min), ("high", F.max))]
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("to_pivot").alias("far"), F.min("to_pivot").alias("near"), *ends).collect()
    cells, spans = len(book), len(axes) + 1
    size, far, near = np.zeros(cells), np.full(cells, -np.inf), np.full(cells, np.inf)
    low, high = np.full((cells, spans), np.inf), np.full((cells, spans), -np.inf)
    for row in summary:
        at = row["cell"]
        size[at], far[at], near[at] = row["n"], row["far"], row["near"]
        low[at], high[at] = [row[f"low{i}"] for i in range(spans)], [row[f"high{i}"] for i in range(spans)]
    return NeighborIndex(placed.select("t_id", "t_vec", "cell"), book, size, far, near, centre, axes, low, high, copies, path)


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"q_id": np.zeros(0, "int64"), "t_id": np.zeros(0, "int64"), "distance": np.zeros(0)})


def _nearest_of(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    return pd.concat(found).sort_values(["q_id", "distance", "t_id"]).groupby("q_id").head(k)


def _kth(ids: np.ndarray, found: pd.DataFrame, k: int) -> np.ndarray:
    """The k-th distance found for each id, infinite where fewer are."""
    lists = found.groupby("q_id")["distance"].agg(["max", "size"])
    return lists["max"].where(lists["size"] >= k, np.inf).reindex(ids, fill_value=np.inf).to_numpy("float64")


def knn_probability(
    queries: DataFrame,
    train: DataFrame,
    k: int = 7,
    id_column: str = "id",
    vector: str = "features",
    label: str = "label",
    index: NeighborIndex | None = None,
    **options,
) -> DataFrame:
    """``q_id, probability``: inverse-distance vote of the k nearest; neighbours at distance 0 decide alone.

    ``index`` may be one built over ``train`` before.
    """
    near = knn_join(queries, train if index is None else index, k, id_column, vector, **options)
    votes = near.join(
        train.select(F.col(id_column).cast("bigint").alias("t_id"), F.col(label).cast("double").alias("_y")), "t_id"
    )
    touching = F.max((F.col("distance") == 0).cast("int")) == 1
    exact = F.sum(F.when(F.col("distance") == 0, F.col("_y"))) / F.sum(F.when(F.col("distance") == 0, 1.0))
    weight = F.try_divide(F.lit(1.0), F.col("distance"))
    return votes.groupBy("q_id").agg(
        F.when(touching, exact).otherwise(F.sum(weight * F.col("_y")) / F.sum(weight)).alias("probability")
    )
