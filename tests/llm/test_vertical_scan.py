import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsieve.llm import vertical_scan as vs

NAN, INF = float("nan"), float("inf")


def whole(vector, d):
    bound = vs.largest_component(d)
    return [math.floor(max(-bound, min(bound, 256 * x))) for x in vector]


def plain_negatives(rows, anchors, d, positives=5, negatives=3, window=(50, 95)):
    """Every anchor against every row."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or len(v) != d or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, whole(v, d))
        good[i] = min(good.get(i, row), row)
    out = set()
    for a, (label, vector) in good.items():
        if a not in anchors:
            continue
        scores = {i: sum(x * y for x, y in zip(vector, v)) for i, (_, v) in good.items() if i != a}
        best = lambda same: sorted((-s, i) for i, s in scores.items() if (good[i][0] == label) == same)
        for ps, p in best(True)[:positives]:
            fits = [(s, i) for s, i in best(False) if window[0] * -ps <= 100 * -s <= window[1] * -ps]
            out |= {(a, p, rank, n, -ps, -s) for rank, (s, n) in enumerate(fits[:negatives], 1)}
    return out


def found_rows(frame, anchor, **settings):
    found = [tuple(r) for r in vs.hard_negatives(frame, anchor, F.col("label"), **settings).collect()]
    assert len(found) == len(set(found))
    return set(found)


AWKWARD = [
    (0, [1.0, 2.0, 0.5], 1), (1, [1.0, 1.9, 0.4], 1), (2, None, 1), (3, [1.0, None, 0.0], 1), (4, [NAN, 1.0, 0.0], 2), (5, [INF, 1.0, 0.0], 2), (6, [1.0], 1), (7, [], 1),
    (8, [0.0, 0.0, 0.0], 1), (9, [0.7, 1.2, 0.2], 2), (10, [0.7, 1.2, 0.2], 2), (11, [0.6, 1.1, 0.3], None), (None, [1.0, 1.0, 1.0], 1), (12, [-3.0, 1.0, 2.0], 2),
    (13, [1e300, 0.0, 0.0], 3), (14, [-1e300, 1.0, 1.0], 3), (15, [2.0, 0.1, 1.0], 2), (15, [0.9, 1.5, 0.4], 2), (15, [0.9, 1.5, 0.4], 2), (16, [0.9, 1.5, 0.4], 1), (20, [1.0, 2.0, 0.5], 1),
]


@pytest.mark.parametrize("positives, negatives, window", [(5, 3, (50, 95)), (1, 1, (0, 100)), (9, 9, (-100, 200))])
def test_awkward_rows(spark, positives, negatives, window):
    frame = spark.createDataFrame([r + ("x", 1) for r in AWKWARD], "vec_id long, embedding array<double>, label int, id string, block int")
    found = found_rows(frame, F.col("vec_id") % 2 == 0, positives=positives, negatives=negatives, window=window)
    assert found == plain_negatives(AWKWARD, set(range(0, 30, 2)), 3, positives, negatives, window)


def test_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    every = F.lit(True)
    assert found_rows(spark.createDataFrame([], schema), every) == set()
    assert found_rows(spark.createDataFrame([(0, None, 1), (1, [1.0], None)], schema), every) == set()
    assert found_rows(spark.createDataFrame([(0, [1.0], 1)], schema), every) == set()
    assert found_rows(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], schema), F.lit(False)) == set()


@pytest.mark.parametrize("block, anchors, columns", [(8192, 512, 8), (50, 7, 3), (64, 3, 1), (1000, 512, 100)])
def test_blocks_and_steps_change_nothing(spark, block, anchors, columns):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 12))
    rows = [(i, (centres[i % 6] + 0.6 * rng.standard_normal(12)).tolist(), int(rng.integers(0, 4))) for i in range(260)]
    rows += [(300 + i, rows[0][1], int(i % 4)) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    assert found_rows(frame, F.col("vec_id") % 10 == 0, block_rows=block, anchor_rows=anchors, step=columns) == plain_negatives(rows, set(range(0, 400, 10)), 12)


def test_groups_and_blocks_meet_without_copies_or_broadcast(spark):
    """A group copied for every block and broadcast passes through the driver, however small Spark takes it to be."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).tolist(), int(i % 3)) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = vs.hard_negatives(frame, F.col("vec_id") % 4 == 0, F.col("label"), block_rows=16, anchor_rows=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate explode" not in plan and "CartesianProduct" in plan
    assert set(map(tuple, found.collect())) == plain_negatives(rows, set(range(0, 400, 4)), 6)


def test_scan_drops_candidates_before_the_last_column():
    rng = np.random.default_rng(6)
    n, d = 4000, 64
    anchor = np.zeros(d, np.int64)
    anchor[:8] = 1000
    columns = rng.integers(-200, 200, (d, n))
    columns[:8, :20] += 2000
    block = vs.Block(np.arange(n), np.zeros(n, np.int64), columns)
    read = []

    class Columns:
        def __getitem__(self, j):
            read.append(j)
            return columns[j]

    block.ends
    block.columns = Columns()
    places, scores = vs.scan(block, anchor, np.ones(n, bool), np.array([vs.LEAST]), np.array([vs.MOST]), 5)
    exact = anchor @ columns
    best = np.argsort(-exact, kind="stable")[:5]
    assert set(best) <= set(places) and (scores == exact[places]).all() and len(places) <= 20
    # Columns come in descending magnitude of the anchor.
    assert set(read[:8]) == set(range(8))


def test_windows_round_to_whole_scores():
    for positive in (-7, -1, 0, 1, 2, 99, 100, 101, 12345):
        low, high = vs.window_of(np.array([positive]), 50, 95)
        fits = [s for s in range(-20000, 20000) if 50 * positive <= 100 * s <= 95 * positive]
        assert fits == list(range(int(low[0]), int(high[0]) + 1))
