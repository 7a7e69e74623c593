import numpy as np
import pytest
from helpers import components
from test_onebit import AWKWARD

from claimsieve.llm import QUERIES, multi_index


def plain_links(rows, d, threshold=0.9):
    good = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and len(v) == d and None not in v and np.isfinite(v).all() and any(v)}
    unit = {k: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for k, v in good.items()}
    return [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= threshold]


def plain_rows(rows, d):
    links = plain_links(rows, d)
    root = components(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    degree = [sum(k in link for link in links) for k in range(len(rows))]
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(root[k])
        out.append((i, degree[k], c, i == c))
    return out


def found_rows(frame):
    return [tuple(r) for r in multi_index.similar_vectors(frame).collect()]


def key(row):
    return tuple((x is None, x) for x in row)


def test_awkward_rows(spark):
    rows = AWKWARD + [(20, [2.0, 4.0, 1.0]), (21, [1.0, 2.1, 0.6])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, home int")
    assert sorted(found_rows(frame), key=key) == sorted(plain_rows(rows, 3), key=key)


def test_empty_and_tiny(spark):
    schema = "vec_id long, embedding array<float>"
    assert found_rows(spark.createDataFrame([], schema)) == []
    assert found_rows(spark.createDataFrame([(3, None)], schema)) == [(3, 0, 3, True)]
    assert sorted(found_rows(spark.createDataFrame([(3, [1.0]), (5, [2.0]), (4, [-1.0])], schema))) == [(3, 1, 3, True), (4, 0, 4, True), (5, 1, 3, False)]


@pytest.mark.parametrize("block", [2048, 16])
def test_clusters_with_crowded_cells(spark, monkeypatch, block):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    rows = [(k, (centres[k % 40] + 0.08 * rng.standard_normal(16)).tolist()) for k in range(300)]
    rows += [(1000 + k, (centres[0] + 0.05 * rng.standard_normal(16)).tolist()) for k in range(150)] + [(2000 + k, centres[1].tolist()) for k in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(found_rows(frame)) == sorted(plain_rows(rows, 16))


def test_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(3)
    index = multi_index.MultiIndex(rng.standard_normal((7, 4)), rng.standard_normal((9, 4)))
    rows = rng.standard_normal((25, 8))
    for visits in (1, 5, 63, 200):
        found = index.ranked(rows, visits)
        for row, cells in zip(rows, found):
            far = {i * 9 + j: ((row[:4] - a) ** 2).sum() + ((row[4:] - b) ** 2).sum() for i, a in enumerate(index.first) for j, b in enumerate(index.second)}
            assert len(set(cells.tolist())) == min(visits, 63)
            assert np.allclose([far[c] for c in cells], sorted(far.values())[: len(cells)])


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    matrix = np.array([v for _, v in rows], float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    degree = dict(zip((i for i, _ in rows), ((matrix @ matrix.T) >= 0.9).sum(axis=1) - 1))
    found = QUERIES["op9_multi_index"](spark, folder).collect()
    assert len(found) == len(rows)
    assert all(r.n_links <= degree[r.vec_id] for r in found)
    assert sum(r.n_links for r in found) >= 0.97 * sum(degree.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_rare_links_are_found(spark):
    """0.2% linked vectors at a cosine just above the threshold: a sample of 400 sees few of them or none."""
    rng = np.random.default_rng(11)
    rows = rng.standard_normal((40_000, 32))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    aside = rng.standard_normal((80, 32))
    aside -= (aside * rows[:80]).sum(axis=1, keepdims=True) * rows[:80]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    rows[80:160] = 0.905 * rows[:80] + (1 - 0.905**2) ** 0.5 * aside
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(8)
    kept = {r.vec_id: r.kept for r in multi_index.similar_vectors(frame).collect()}
    assert sum(not kept[k] for k in range(80, 160)) >= 78


def test_more_cells_are_considered_until_the_recall_holds(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "FIRST_CELLS", 1)
    monkeypatch.setattr(multi_index, "CELL_ROWS", 1)
    rng = np.random.default_rng(6)
    # Pairs at a cosine of about 0.3, which cells of a fine grid keep apart.
    base = rng.standard_normal((150, 8))
    near = 0.35 * base + rng.standard_normal((150, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen, needed = [], multi_index.visits_needed

    def watch(*arguments):
        seen.append((arguments[-1], needed(*arguments)))
        return seen[-1][1]

    monkeypatch.setattr(multi_index, "visits_needed", watch)
    found = sorted(tuple(r) for r in multi_index.similar_vectors(frame, threshold=0.3, recall=1.0).collect())
    cells = [c for c, _ in seen]
    assert cells[0] == 1 and max(cells) > 128 and all(b <= 2 * a for a, b in zip(cells, cells[1:]))
    assert all(v is None for _, v in seen[:-1])
    links = plain_links(rows, 8, 0.3)
    assert sum(r[1] for r in found) == 2 * len(links)


def test_the_recall_is_not_taken_for_reached():
    counts = np.array([[3.0, 0, 1], [2, 0, 0]])
    assert multi_index.enough_visits(counts, 0.7) == 1
    assert multi_index.enough_visits(counts, 0.9) is None
