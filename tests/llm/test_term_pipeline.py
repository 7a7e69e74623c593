import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import DOC_ROWS, doc_table

from claimsieve.llm import term_pipeline as tp

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall(text.translate(LOWER)) if text is not None else []


def plain_search(docs, items, k=10):
    """Every document against every item, from the formulas."""
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = set()
    for item, words in wanted.items():
        scored = []
        for doc, c, n in counts:
            score = 0
            for t in words & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + 90 * n * n_docs // total
                score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            out.add((item, rank, doc, -score))
    return out


def found_by(docs, items, **settings):
    return [tuple(r) for r in tp.search(docs, items, **settings).collect()]


ITEMS = [(1, "The CAT sat"), (2, None), (3, ""), (4, "!!!"), (5, "word Word é chat le"), (None, "the dog"), (1, "park"), (6, "nothing-here zzz"), (7, "12345 the"), (8, "ÀÉ é")]


def test_terms_of_awkward_texts():
    for text in [r[1] for r in DOC_ROWS] + ["aB_c\x7fd", "É É", "a-b'c", "漢字kanji 9", "\x80x", "A" * 70_000]:
        assert [t.decode() for t in tp.terms_of(text)] == terms(text)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_awkward_rows(spark, k):
    docs = doc_table(spark)
    items = spark.createDataFrame([i + ("x",) for i in ITEMS], "item_id long, text string, rank string")
    found = found_by(docs, items, k=k)
    assert len(found) == len(set(found)) and set(found) == plain_search([(r.doc_id, r.text) for r in docs.collect()], ITEMS, k)


def test_empty_tables(spark):
    docs, items = doc_table(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found_by(docs.limit(0), items) == [] and found_by(docs, items.limit(0)) == [] and found_by(docs.limit(0), items.limit(0)) == []
    nulls = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert found_by(nulls, items) == []


def random_corpus(seed, documents, items, words=60):
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(1, words + 1)
    chance /= chance.sum()
    text = lambda n: " ".join(f"w{w}" for w in rng.choice(words, n, p=chance))
    docs = [(int(i), text(int(rng.integers(0, 30)))) for i in rng.permutation(documents)]
    docs += [(documents + i, docs[0][1]) for i in range(25)]
    return docs, [(i, text(int(rng.integers(1, 9)))) for i in range(items)]


@pytest.mark.parametrize(
    "sizes", [tp.Sizes(), tp.Sizes(16, group_items=3), tp.Sizes(64, 40, 7, 2), tp.Sizes(30, stages=1), tp.Sizes(17, group_items=5, stages=9), tp.Sizes(50, slots=8)]
)
def test_blocks_groups_stages_and_slots_change_nothing(spark, sizes):
    docs, items = random_corpus(7, 300, 20)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = found_by(frame, spark.createDataFrame(items, "item_id long, text string"), k=4, sizes=sizes)
    assert len(found) == len(set(found)) and set(found) == plain_search(docs, items, 4)


def test_accumulators_leave_out_what_cannot_win():
    """Rare terms first: once the best are known, common terms open no new accumulators."""

    class Bundle:
        sizes = np.full(50, 10, np.int64).tobytes()
        cells = np.arange(5, dtype=np.uint32).tobytes()
        sums = np.array([90, 80, 70, 60, 5], np.int64).tobytes()
        items = tp.pack_ids([1])

    low = pd.DataFrame({"w": [1], "items": [np.array([0])], "places": [np.arange(50, dtype=np.uint16).tobytes()], "counts": [np.ones(50, np.uint32).tobytes()]})
    bundle = Bundle()
    potential = np.zeros((5, 1), np.int64)
    potential[:2] = 10
    bundle.potential = potential.tobytes()
    cells, sums = tp.run_stage(bundle, low.iloc[:0], 0, 3, (50, 500))
    # 5 + 10 can't reach the third best sum of 70, 60 + 10 can.
    assert cells.tolist() == [0, 1, 2, 3] and sums.tolist() == [90, 80, 70, 60]
    bundle.cells, bundle.sums = cells.astype(np.uint32).tobytes(), sums.tobytes()
    cells, _ = tp.run_stage(bundle, low, 1, 3, (50, 500))
    assert set(cells.tolist()) <= {0, 1, 2, 3}


def test_weights_of_one_document(spark):
    docs = spark.createDataFrame([(1, "only words here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert set(found_by(docs, items)) == plain_search([(1, "only words here")], [(1, "words")])
