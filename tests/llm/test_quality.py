import math
import zlib
from collections import Counter

from helpers import doc_table

from claimsieve.llm import QUERIES, quality
from pyspark.sql import functions as F


def bucket(word):
    total = sum((b + 1) * pow(0x100000001B3, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)
    return ((total ^ (total >> 29)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - quality.BITS)


def test_buckets_of_all_words_at_once():
    for text in ("", " ", "a", " a  bc\t\nd\x0b", "é 漢字 🙂\x1cx", "x" * 70_000 + " y", "\ud800 z", "a\0b c"):
        expected = [bucket(w) for w in text.encode("utf-8", "surrogatepass").split()]
        assert quality.word_buckets(text).tolist() == expected


def test_features():
    found = quality.features("a b b\tc")
    a, b, c = (bucket(w) for w in (b"a", b"b", b"c"))
    assert found[:4].tolist() == [a, b, b, c]
    assert found[5] == quality.FEATURES - 1 and len(found) == 7
    assert all((1 << quality.BITS) <= x < quality.FEATURES for x in found[4:])
    assert len(quality.features(None)) == len(quality.features(" \n")) == len(quality.features("")) == 0


def test_counts_against_a_plain_version(spark):
    docs = doc_table(spark).withColumn("aim", (F.col("lang") == "en").cast("int"))
    docs = docs.fillna({"aim": 0})
    expected = Counter()
    for r in docs.collect():
        expected.update((r.aim, int(f)) for f in quality.features(r.text))
    assert {(r.g, r.feature): r.n for r in quality.count_features(docs, "text", "aim").collect()} == expected


def test_awkward_rows_keep_columns(spark):
    docs = doc_table(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (7, 1, None), (7, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        model = quality.fit_classifier(docs, marks)
        weighed = quality.weigh(docs, model, into="language")
        assert weighed.columns == docs.columns + ["_language"]
        assert weighed.count() == docs.count()
        for r in weighed.collect():
            if not (r.text or "").strip():
                assert r._language.accepted and r._language.log_weight == 0
    assert quality.weigh(docs.limit(0), model).count() == 0


def test_gumbel_sample_is_the_top_k(spark):
    rows = [(i, float(i % 7)) for i in range(5000)] + [(None, 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, log_weight double")
    for share in (0.0, 0.1, 0.5, 1.0):
        found = quality.resample(frame, share, "log_weight", "doc_id").collect()
        k = round(share * len(rows))
        chosen = [r for r in found if r.selected]
        assert len(chosen) == k
        top = sorted(found, key=lambda r: -r.gumbel_key)[:k]
        assert {r.doc_id for r in top} == {r.doc_id for r in chosen}
    noise = [r.gumbel_key - r.log_weight for r in found]
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.08
    assert quality.resample(frame.limit(0), 0.5, "log_weight", "doc_id").count() == 0


def test_classifier_on_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op4_quality"](spark, folder).join(labels, "doc_id").collect()
    bad = [r for r in found if r.quality == 0]
    good = [r for r in found if r.quality == 1 and r.toxic == 0]
    assert sum(not r.accepted for r in bad) / len(bad) > 0.9
    assert sum(r.accepted for r in good) / len(good) > 0.98
    assert all(math.isclose(r.mean_log_weight * r.n_features, r.log_weight, abs_tol=1e-6) for r in found)


def test_toxic_words_in_ordinary_prose_are_rejected(spark):
    """Toxic texts of quality 1 among the labels that were kept out of the fit."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1")
    rows = QUERIES["op4_quality"](spark, folder).join(labels, "doc_id").select("accepted", "toxic", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held")).collect()
    toxic = [r for r in rows if r.held and r.toxic == 1]
    good = [r for r in rows if r.toxic == 0]
    print("figures", sum(not r.accepted for r in toxic), len(toxic), sum(not r.accepted for r in rows if r.toxic == 1), sum(r.toxic for r in rows), sum(not r.accepted for r in good), len(good))
    assert sum(not r.accepted for r in toxic) / len(toxic) > 0.5
    assert sum(r.accepted for r in good) / len(good) > 0.995


def plain_model(docs, labels):
    """Both ratios by a plain loop over texts, from the formulas."""
    size = 1 << quality.BITS
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    raw, target = Counter(), Counter()
    seen, groups = (Counter(), Counter()), [0, 0]
    for i, text in docs:
        found = quality.features(text).tolist()
        raw.update(found)
        if i in labels and i not in held:
            good, toxic = labels[i]
            if good:
                target.update(found)
            groups[toxic] += 1
            seen[toxic].update(set(found))
    ratio = {}
    for low, high in ((0, size), (size, quality.FEATURES)):
        n = high - low
        r_total, t_total = sum(c for f, c in raw.items() if low <= f < high), sum(c for f, c in target.items() if low <= f < high)
        for f in range(low, high):
            if raw[f]:
                prior = (raw[f] + 1e-3) / (r_total + 1e-3 * n)
                ratio[f] = math.log((target[f] + 0.01 * n * prior) / (t_total + 0.01 * n) / prior)
    toxic = {}
    for f in seen[1]:
        one, other = seen[1][f] + 0.5, seen[0][f] + 0.5
        toxic[f] = max(0.0, math.log(one / (groups[1] + 1)) - math.log(other / (groups[0] + 1)) - 4 * math.sqrt(1 / one + 1 / other))
    return ratio, toxic


def test_weights_and_decisions_against_a_plain_version(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    worst = {}
    for r in labels.collect():
        good, toxic = worst.get(r.doc_id, (True, 0))
        worst[r.doc_id] = (good and r.quality == 1 and not r.toxic, max(toxic, r.toxic or 0))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    ratio, toxic = plain_model(texts, worst)
    model = quality.fit_classifier(docs, labels)
    found = {r.doc_id: r.importance for r in quality.weigh(docs, model).collect()}
    for i, text in texts:
        features = quality.features(text).tolist()
        weight = math.fsum(ratio[f] for f in features)
        mean = weight / max(1, len(features))
        poison = math.fsum(toxic.get(f, 0.0) for f in set(features))
        assert found[i].n_features == len(features)
        assert math.isclose(found[i].log_weight, weight, rel_tol=1e-9, abs_tol=1e-6) and math.isclose(found[i].mean_log_weight, mean, rel_tol=1e-9, abs_tol=1e-9)
        if min(abs(mean - model.min_mean), abs(weight - model.min_total), abs(poison - model.max_toxic)) > 1e-6:
            assert found[i].accepted == ((mean >= model.min_mean or weight >= model.min_total) and poison <= model.max_toxic)
