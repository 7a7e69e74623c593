import sys
from pathlib import Path

from helpers import doc_table
from test_simhash import plain_classes

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from claimsieve.llm import quality  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_on_awkward_rows(spark):
    docs = doc_table(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SMALL).count() == docs.count()
    assert last(spark, docs.limit(0), SMALL).count() == 0


def test_each_stage_does_its_part(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    spoken = stages["language ID"](spark, docs, SMALL)
    gone = set(texts) - {r.doc_id for r in spoken.collect()}
    assert all(not any(c.isalpha() for c in texts[i] or "") for i in gone)

    single = stages["SimHash near-dedup"](spark, docs, SMALL)
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in plain_classes(list(texts.items()))}

    model = quality.fit_classifier(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = stages["quality classifier"](spark, docs, SMALL)
    accepted = quality.weigh(docs, model).filter("importance.accepted")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in accepted.collect()}

    mixed = stages["mixing sources to target weights"](spark, docs, SMALL)
    words = sum(len((t or "").encode().split()) for t in texts.values())
    taken = sum(len((r.text or "").encode().split()) for r in mixed.collect())
    assert abs(taken - 1.5 * words) < 0.05 * words


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, docs.collect()))
