import math
from collections import Counter

import numpy as np
from helpers import doc_table

from claimsieve.llm import QUERIES, language_id
from claimsieve.llm.frames import text_blocks


def plain_grams(text, orders=(1, 2, 3)):
    folded = "".join(c.lower() if c.isalpha() else " " for c in text)
    while "  " in folded:
        folded = folded.replace("  ", " ")
    return [folded[i : i + n] for n in orders for i in range(len(folded) - n + 1) if folded[i : i + n].strip()]


def bucket(gram, bits=16):
    rolled = 0
    for k, c in enumerate(gram):
        rolled = (rolled * 0x01000193 + ord(c) + k + 1) & 0xFFFFFFFF
    rolled ^= rolled >> 15
    return ((rolled * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits)


def test_ngrams_match_a_plain_version():
    texts = ["Ab c!d", "", "é", "  x  yz "]
    for text in texts:
        found = []
        assert Counter(grams_of(text)) == Counter(bucket(g) for g in plain_grams(text))


def grams_of(text, orders=(1, 2, 3)):
    found = []
    for _, points, carried in language_id.letter_blocks([text], max(orders) - 1):
        found += [b for row in language_id.hashed_ngrams(points, orders, 16, carried) for b in row.tolist() if b != 1 << 16]
    return found


def test_no_ngram_is_lost_where_a_long_text_is_cut(monkeypatch):
    text = "ab  c, d" * 9 + "é!?? \0" * 5 + "   " * 4 + "xyz"
    for size in range(1, 40):
        monkeypatch.setattr(language_id, "BLOCK_CHARS", size)
        for orders in ((1, 2, 3), (2,), (1,), (1, 4)):
            assert Counter(grams_of(text, orders)) == Counter(bucket(g) for g in plain_grams(text, orders)), (size, orders)


def test_a_text_above_the_block_size():
    text = "the quick brown fox, " * 30_000
    assert len(text) > 2 * language_id.BLOCK_CHARS
    assert Counter(grams_of(text)) == Counter(bucket(g) for g in plain_grams(text))


def test_blocks_hold_all_characters_of_long_texts():
    texts = ["abc" * 50, None, "", "xyz"]
    pieces = {}
    for rows, points in text_blocks(texts, size=40):
        for row, piece in zip(rows, "".join(map(chr, points)).split("\0")):
            pieces[row] = pieces.get(row, "") + piece
    assert pieces == {0: texts[0], 2: "", 3: "xyz"}


def test_model_and_scores_match_plain_bayes(spark):
    docs = doc_table(spark)
    model = language_id.train_language_model(docs)
    assert model.languages == ["en", "fr"]
    rows = docs.collect()
    counts = {lang: Counter() for lang in model.languages}
    for r in rows:
        if r.lang and r.text is not None:
            counts[r.lang].update(bucket(g) for g in plain_grams(r.text))
    for i, lang in enumerate(model.languages):
        total = sum(counts[lang].values()) + 0.5 * (1 << 16)
        expected = np.array([math.log((counts[lang][b] + 0.5) / total) for b in range(1 << 16)])
        assert np.allclose(model.log_prob[:-1, i], expected)
    predicted = language_id.predict_language(docs, model, into="language")
    assert predicted.columns[:-1] == docs.columns and predicted.columns[-1] == "_language"
    for r in predicted.collect():
        text = r.text or ""
        if not any(c.isalpha() for c in text):
            assert (r._language.lang_pred, r._language.score) == ("und", 0.0)
            continue
        logs = [sum(model.log_prob[bucket(g), i] for g in plain_grams(text)) + model.log_prior[i] for i in range(2)]
        best = int(np.argmax(logs))
        assert r._language.lang_pred == model.languages[best]
        assert math.isclose(r._language.score, 1 / sum(math.exp(min(0, x - logs[best])) for x in logs), rel_tol=1e-6)


def test_no_labels_and_no_rows(spark):
    docs = doc_table(spark)
    model = language_id.train_language_model(docs.filter("lang = 'none'"))
    assert model.languages == []
    assert {r[0] for r in language_id.predict_language(docs, model).select("_language.lang_pred").collect()} == {"und"}
    assert language_id.predict_language(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    joined = QUERIES["op1_language_id"](spark, sf_dir).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert joined and sum(r.lang == r.lang_pred for r in joined) / len(joined) > 0.97
    assert all(0 <= r.score <= 1 for r in joined)
