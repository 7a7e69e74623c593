import math
from collections import defaultdict

import pytest
from helpers import doc_table

from claimsieve.llm import QUERIES, mixing


def plain_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, full = share * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        if not free:
            return {s: most * sizes[s] for s in names}
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if target[s] >= most * sizes[s]}
        if not above:
            return target | {s: most * sizes[s] for s in full}
        full |= above


def sizes_of(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    return sizes


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, None: 60, "é": 1}, {"x": 7}, {"a": 0, "b": 10}, {"a": 0}, {f"s{i}": 10 * i + 1 for i in range(20)}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(frame, 1.5, 2, mixing.WEIGHTS).collect()}
    for s, t in plain_targets(sizes).items():
        assert math.isclose(found[s], t, abs_tol=1e-9)


def plain_rates(sizes, target, most=2.0):
    """Bisection on the multiplier."""
    scale = sum(sizes) / len(sizes)
    low, high = -1e4, 1e4
    for _ in range(200):
        m = (low + high) / 2
        got = sum(x * min(most, math.exp(min(50, m * x / scale))) for x in sizes if x)
        low, high = (m, high) if got < target else (low, m)
    return m


def test_rates_solve_the_dual(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    found = QUERIES["op3_mixing"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(rows)
    targets = plain_targets(sizes_of(rows.values()))
    by_source = defaultdict(list)
    for r in found:
        by_source[rows[r.doc_id].source].append(r)
    for source, part in by_source.items():
        assert all(math.isclose(r.target, targets[source]) for r in part)
        assert sum(r.size for r in part) == part[0].source_size
        assert math.isclose(sum(r.size * r.rate for r in part), targets[source], rel_tol=1e-6)
        m = plain_rates([r.size for r in part], targets[source])
        scale = part[0].source_size / len(part)
        if targets[source] < 2 * part[0].source_size:
            for r in part:
                assert math.isclose(r.rate, min(2, math.exp(min(50, m * r.size / scale))), rel_tol=1e-4)
        # What is missed or exceeded is about the size of one small document.
        assert abs(sum(r.taken for r in part) - targets[source]) <= max(0.02 * targets[source], max(r.size for r in part) / 2)
        assert all(r.taken in (0, r.size, 2 * r.size) and r.taken == r.size * r.copies for r in part)
    again = QUERIES["op3_mixing"](spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_word_count(spark):
    rows = doc_table(spark).select("text", mixing.word_count(mixing.col("text")).alias("n")).collect()
    assert all(r.n == len((r.text or "").encode().split()) for r in rows)


def test_awkward_rows(spark):
    docs = doc_table(spark)
    mixed = mixing.mix_sources(docs).collect()
    assert len(mixed) == docs.count()
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in mixed)
    assert mixing.take_mix(docs.limit(0)).count() == 0


def test_nothing_is_taken_from_sources_without_share_or_weight(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 1), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    assert {r.copies for r in mixing.mix_sources(docs, share=0.0).collect()} == {0}
    found = mixing.mix_sources(docs, weights=(3.0, 0.0, 2.0)).collect()
    by_source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = {}, {}
    for r in found:
        taken[by_source[r.id]] = taken.get(by_source[r.id], 0) + r.size * r.copies
        target[by_source[r.id]] = r.target
    total = sum(r.size for r in found)
    assert taken["b"] == 0 and target["b"] == 0
    assert abs(target["a"] + target["c"] - min(1.5 * total, 2 * total * 2 / 3)) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 10 for s in "ac")
    assert {r.copies for r in mixing.mix_sources(docs, weights=(0.0,)).collect()} == {0}
