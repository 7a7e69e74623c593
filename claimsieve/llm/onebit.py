"""Nearest neighbours by largest inner product, over randomly rotated one-bit codes.

A vector o is turned by a random rotation and kept as the signs of its coordinates, packed into bits, with two
scalars: its length and the inner product f of its direction with its code. An inner product
with a query q is then estimated as |o| <code, q> / f, and the error of the estimate is
below |o| |q| sqrt((1 - f^2) / f^2) * EPSILON / sqrt(d - 1) but for rare cases. Within a block of vectors the
best estimates are computed exactly first; the 20th of these is what any other vector must
be able to reach, by its estimate plus its error bound, to be computed too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..session import stored
from .frames import col
from .vectors import dimension, lengths, matrix, unit, usable

#: Width of the error bound in standard deviations of an estimate, about.
EPSILON = 1.9
#: Vectors and queries per block.
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
#: Candidates computed exactly before the bound is set, per neighbour wanted.
FIRST_LOOK = 4


def rotation(d: int, seed: int = 29) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(rows: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of directions with their codes."""
    turned = unit(rows) @ turn.T
    return np.packbits(turned > 0, axis=1), lengths(rows), np.abs(turned).sum(axis=1) / np.sqrt(rows.shape[1])


def estimates(bits: np.ndarray, f: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, vectors) estimated inner products of directions, and the error bound of each vector."""
    d = queries.shape[1]
    turned = (unit(queries) @ turn.T).astype(np.float32)
    codes = np.unpackbits(bits, axis=1, count=d).astype(np.float32)
    # The code is 2 * bit - 1, over the root of d.
    products = (2 * turned @ codes.T - turned.sum(axis=1, keepdims=True)) / np.float32(np.sqrt(d))
    bound = np.sqrt(np.maximum(1 - f**2, 0)) / f * EPSILON / np.sqrt(max(d - 1, 1))
    return products / f.astype(np.float32), bound


def inner(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in doubles, summed row by row: equal rows give equal products, whatever rows stand beside them."""
    return (rows.astype(np.float64) * q).sum(axis=1)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of different ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    first_of_id = np.sort(np.unique(ids[order], return_index=True)[1])
    return order[first_of_id][:k]


def search_block(ids, rows, bits, length, f, query_ids, queries, turn, k) -> pd.DataFrame:
    """The k best of a block for each query, with exact scores."""
    guess, bound = estimates(bits, f, queries, turn)
    sizes = lengths(queries)
    out = []
    for i, (name, q) in enumerate(zip(query_ids, queries)):
        able = ids != name
        # Products of huge lengths may overflow; what can't be compared is computed exactly.
        with np.errstate(over="ignore", invalid="ignore"):
            reach = length * sizes[i]
            row = np.where(able, np.nan_to_num(guess[i] * reach, nan=np.inf), -np.inf)
            upper = (guess[i] + bound) * reach
        look = min(FIRST_LOOK * k, len(ids))
        first = np.argpartition(-row, look - 1)[:look] if look < len(ids) else np.arange(len(ids))
        first = first[able[first]]
        if not len(first):
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            exact = inner(rows[first], q)
            best = best_of(ids[first], exact, k)
            if len(best) == k:
                more = np.setdiff1d(np.flatnonzero(able & ~(upper < exact[best[-1]])), first, assume_unique=True)
                first, exact = np.append(first, more), np.append(exact, inner(rows[more], q))
                best = best_of(ids[first], exact, k)
        out.append(pd.DataFrame({"query_id": name, "vec_id": ids[first][best], "score": exact[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def block_index(good: DataFrame, d: int, blocks: int) -> DataFrame:
    """The index, written as a table: a row per block with ids, vectors, packed codes, lengths and code products."""
    turn = rotation(d)
    kind = np.float32 if good.schema["vec"].dataType.elementType == FloatType() else np.float64

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = matrix(part["vec"], d)
        bits, length, f = encode(rows, turn)
        # Originals as wide as they came; products are taken in doubles.
        return pd.DataFrame({
            "block": [int(key[0])], "ids": [part["id"].to_numpy(np.int64).tobytes()], "rows": [rows.astype(kind).tobytes()],
            "bits": [bits.tobytes()], "length": [length.tobytes()], "f": [f.tobytes()],
        })

    dealt = good.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int"))
    return stored(dealt.groupBy("block").applyInPandas(pack, "block int, ids binary, rows binary, bits binary, length binary, f binary"), "onebit-index")


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds its k best other rows.

    Score is the inner product in double precision; ties go to the smaller id. Vectors that are null,
    zero, of another length than most, or hold a null or non-finite component take no part, nor do
    rows without id. Rows with the query's id count as the query itself; a repeated id
    is listed once, with its best score. Blocks of queries meet blocks of the index, never single rows.
    """
    d = dimension(vectors, vector)
    good = vectors.filter(col(key).isNotNull() & usable(col(vector), d))
    queries = good.filter(is_query).select(col(key).cast("long").alias("id"), col(vector).alias("vec"))
    good = good.select(col(key).cast("long").alias("id"), col(vector).alias("vec"))
    total, asked = good.count(), queries.count()
    blocks, groups = max(1, -(-total // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    index = block_index(good, max(d, 1), blocks)

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"query_ids": [part["id"].to_numpy(np.int64).tobytes()], "queries": [matrix(part["vec"], d).tobytes()]})

    dealt = queries.withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.lit(groups)))
    packed = dealt.groupBy("part").applyInPandas(pack, "query_ids binary, queries binary")
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    turn = rotation(max(d, 1))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                ids = np.frombuffer(b.ids, np.int64)
                rows = np.frombuffer(b.rows, np.float32 if len(b.rows) == 4 * d * len(ids) else np.float64).reshape(-1, d)
                bits = np.frombuffer(b.bits, np.uint8).reshape(len(ids), -1)
                yield search_block(
                    ids, rows, bits, np.frombuffer(b.length), np.frombuffer(b.f),
                    np.frombuffer(b.query_ids, np.int64), np.frombuffer(b.queries).reshape(-1, d), turn, k,
                ).astype({"query_id": np.int64, "vec_id": np.int64, "score": float})

    met = packed.join(index, "block").repartition(max(1, min(blocks * groups, 10_000)))
    found = met.mapInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
