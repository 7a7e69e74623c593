import numpy as np
import pytest

from claimsieve.llm import QUERIES, onebit
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
AWKWARD = [
    (1, [1.0, 2.0, 0.5]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 0.0]), (5, [NAN, 1.0, 0.0]), (6, [INF, 1.0, 0.0]), (7, [1.0]),
    (8, [1.0, 2.0, 0.5]), (9, [1.0, 2.0, 0.5]), (10, [-3.0, 1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (11, []), (12, [1e200, 0.0, 0.0]), (13, [1e-200, 0.0, 0.0]),
    (14, [2.0, 0.0, 1.0]), (14, [2.0, 0.0, 1.0]),
]


def plain_nearest(rows, queries, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 3 and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for q, vector in good:
        if q in queries:
            best = sorted({(-float(vector @ v), i) for i, v in good if i != q})[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("k", [1, 3, 20])
def test_awkward_rows(spark, k):
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in AWKWARD], "vec_id long, embedding array<double>, score int, rank string")
    found = {(r.query_id, r.rank, r.vec_id, r.score) for r in onebit.nearest(frame, F.col("vec_id") % 2 == 0, k=k).collect()}
    expected = plain_nearest(AWKWARD, {2, 4, 6, 8, 10, 12, 14}, k)
    assert {x[:3] for x in found} == {x[:3] for x in expected}
    assert np.allclose(sorted(x[3] for x in found), sorted(x[3] for x in expected))


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert onebit.nearest(empty, F.col("vec_id") % 2 == 0).count() == 0
    nulls = spark.createDataFrame([(2, None)], "vec_id long, embedding array<float>")
    assert onebit.nearest(nulls, F.col("vec_id") % 2 == 0).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    rows, queries, turn = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64)), onebit.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    bits, length, f = onebit.encode(rows, turn)
    assert bits.shape == (2000, 8) and np.allclose(length, np.linalg.norm(rows, axis=1))
    guess, bound = onebit.estimates(bits, f, queries, turn)
    cosines = onebit.unit(queries) @ onebit.unit(rows).T
    assert (np.abs(guess - cosines) <= bound).mean() > 0.93
    assert abs((guess - cosines).mean()) < 0.01


def test_recall_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(onebit, "BLOCK_ROWS", 300)
    monkeypatch.setattr(onebit, "QUERY_ROWS", 10)
    folder = "/root/testdata/sf0.1"
    rows = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    found = QUERIES["op6_onebit_neighbours"](spark, folder).collect()
    expected = {}
    ids = np.array(sorted(rows))
    matrix = np.array([rows[i] for i in ids])
    for q in ids[ids % 20 == 0]:
        scores = matrix @ rows[q]
        order = np.lexsort((ids, -scores))
        expected[q] = [i for i in ids[order] if i != q][:20]
    hits = sum(r.vec_id in expected[r.query_id] for r in found)
    assert len(found) == 20 * len(expected)
    assert hits / len(found) >= 0.97
    for r in found:
        assert np.isclose(r.score, rows[r.query_id] @ rows[r.vec_id], rtol=1e-12)


@pytest.mark.parametrize("block_rows", [7, 43, 8192])
def test_equal_vectors_score_equally_and_stand_by_id(spark, monkeypatch, block_rows):
    monkeypatch.setattr(onebit, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(4)
    copy = rng.standard_normal(24).astype(np.float32).tolist()
    rows = [(i, copy if i % 4 else rng.standard_normal(24).astype(np.float32).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for k in (5, 20, 59):
        found = onebit.nearest(frame, F.col("vec_id") % 5 == 0, k=k).collect()
        by_query = {}
        for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
            by_query.setdefault(r.query_id, []).append(r)
        vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
        for q, hits in by_query.items():
            assert len({h.score for h in hits if h.vec_id % 4}) <= 1
            assert [h.rank for h in hits] == list(range(1, len(hits) + 1)) and len(hits) == k
            assert [(-h.score, h.vec_id) for h in hits] == sorted((-h.score, h.vec_id) for h in hits)
            exact = sorted((-float((vectors[i] * vectors[q]).sum()), i) for i, _ in rows if i != q)[:k]
            assert [h.vec_id for h in hits] == [i for _, i in exact]
