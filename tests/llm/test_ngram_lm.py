import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import doc_table, words
from pyspark.sql import functions as F

from claimsieve.llm import QUERIES, ngram_lm

END = b""


def plain_scores(rows, weights):
    """Base and model score of (id, text, role) rows from plain dictionaries, with the given weights per bucket."""
    single, pairs = Counter(), Counter()
    for _, text, role in rows:
        if role:
            tokens = words(text) + [END]
            single.update(tokens)
            pairs.update(zip([END] + tokens[:-1], tokens))
    total, known = sum(single.values()), len(single)
    out = []
    for i, text, role in rows:
        tokens = words(text) + [END]
        base = sum(math.log10((single[t] + 1) / (total + known + 1)) for t in tokens)
        score = 0.0
        for h, w in zip([END] + tokens[:-1], tokens):
            a = weights[int(math.log2(single[h])) + 1 if single[h] else 0]
            score += math.log10(a[0] * pairs[h, w] / max(single[h], 1) + a[1] * single[w] / max(total, 1) + a[2] / (known + 1))
        out.append((i, role == 0, len(tokens), sum(single[t] > 0 for t in tokens), total, base, score))
    return out


@pytest.mark.parametrize("chunk", [1 << 19, 40])
def test_against_plain_dictionaries(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_lm, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(ngram_lm, "SLICE_BYTES", 1000)
    kept = {}
    learn = ngram_lm.learn_weights
    monkeypatch.setattr(ngram_lm, "learn_weights", lambda *a: kept.setdefault("weights", learn(*a)))
    docs = doc_table(spark)
    held, fold = F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 == 1
    found = ngram_lm.score_documents(docs, held, fold).collect()
    rows = [(r.doc_id, r.text, 1 if r.doc_id is None else {0: 0, 1: 2, 2: 1}[r.doc_id % 3]) for r in docs.collect()]
    expected = plain_scores(rows, kept["weights"])
    order = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert len(found) == len(expected)
    for a, b in zip(sorted(map(tuple, found), key=order), sorted(expected, key=order)):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    docs = doc_table(spark)
    found = ngram_lm.score_documents(docs, F.lit(True), F.lit(False)).collect()
    assert len(found) == docs.count() and all(r.train_tokens == r.n_known == 0 and r.held_out and r.base_score == 0 for r in found)
    assert all(math.isfinite(r.score) for r in found)
    assert ngram_lm.score_documents(docs.limit(0), F.lit(False), F.lit(True)).count() == 0


def test_weights_recover_the_mixture_that_made_the_counts():
    true = np.array([0.55, 0.35, 0.1])
    rng = np.random.default_rng(0)
    kinds = [(8, 40), (16, 80), (-1, 40), (-1, -1), (4, 120)]
    chances = np.array([[2.0 ** (-s / 8) if s >= 0 else 0, 2.0 ** (-f / 8) if f >= 0 else 0, 1e-4] for s, f in kinds])
    cells = pd.DataFrame([(3, s, f, n) for (s, f), n in zip(kinds, rng.multinomial(200000, (chances @ true) / (chances @ true).sum()))], columns=["bucket", "second", "first", "n"])
    learnt = ngram_lm.learn_weights(cells, 1e-4, rounds=300)
    likelihood = lambda a: (cells["n"] * np.log(chances @ a)).sum()
    assert np.isclose(learnt.sum(axis=1), 1).all() and likelihood(learnt[3]) >= likelihood(true) - 1e-6
    assert learnt[0][0] == 0


def test_model_is_a_distribution(spark):
    """Over all known words and one unknown, the chances after any context sum to 1."""
    single = {b"a": 5, b"b": 3, END: 2}
    pairs = {(b"a", b"b"): 3, (b"a", END): 2}
    a = ngram_lm.DEFAULT_WEIGHTS
    total = sum(a[0] * pairs.get((b"a", w), 0) / 5 + a[1] * single.get(w, 0) / 10 + a[2] / 4 for w in (b"a", b"b", END, b"?"))
    assert math.isclose(total, 1)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op7_ngram_lm"](spark, sf_dir).collect()
    part = {i: zlib.crc32(str(i).encode()) % 7 for i in texts}
    expected = {r[0]: r for r in plain_scores([(i, t, 0 if part[i] == 2 else 1) for i, t in texts.items()], [(0.3, 0.6, 0.1)] * 50)}
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r)[:5] == expected[r.doc_id][:5]
        assert math.isclose(r.base_score, expected[r.doc_id][5], rel_tol=1e-9)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
