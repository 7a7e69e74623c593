"""Forests scored a batch of rows at a time, and what calibrate_rf reads and spreads before it."""

import numpy as np
from conftest import plan_text
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from claimsieve.catalog import learning
from claimsieve.learning import forest, models


def rows_of(spark, x, labels):
    data = [(i, [float(v) for v in row], int(y)) for i, (row, y) in enumerate(zip(x, labels))]
    return spark.createDataFrame(data, "id long, features array<double>, label int")


def own_probability(model, frame):
    scored = model.transform(frame.withColumn("features", array_to_vector("features")))
    return {r["id"]: r["p"] for r in scored.select("id", vector_to_array("probability")[1].alias("p")).collect()}


def fitted(spark, trees=7, depth=6):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(500, 4)), 1)
    train = rows_of(spark, x, (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=500) > 0.3).astype(int))
    return x, train, models.train_random_forest(train, models.small_config(rf_trees=trees, rf_depth=depth))


def test_batches_give_the_probabilities_of_the_model(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 64)
    x, train, model = fitted(spark)
    limits = np.unique(np.concatenate([t[1][~np.isnan(t[1])] for t in forest.forest_trees(model, spark)]))
    odd = np.array([np.resize(limits[i:], 4) for i in range(len(limits))])  # values that are thresholds
    odd = np.concatenate([odd, [[np.nan] * 4, [np.inf] * 4, [-np.inf] * 4, [0.0, np.nan, -0.0, np.inf]], x])
    frame = rows_of(spark, odd, np.zeros(len(odd)))
    want = own_probability(model, frame)
    assert forest.positive_share(forest.forest_trees(model, spark), odd).tolist() == [want[i] for i in range(len(odd))]
    scored = models.add_probability(model, frame, "p")
    assert {r["id"]: r["p"] for r in scored.collect()} == want and len(set(want.values())) > 50
    assert models.add_probability(model, frame.limit(0), "p").count() == 0


def test_forests_of_several_folds_share_one_pass(spark):
    _, train, model = fitted(spark)
    _, _, other = fitted(spark, trees=3, depth=3)
    both = models.add_probabilities(train, {"a": model, "b": other}).select("id", "a", "b")
    assert plan_text(both).split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1
    first, second = own_probability(model, train), own_probability(other, train)
    assert {r["id"]: (r["a"], r["b"]) for r in both.collect()} == {i: (first[i], second[i]) for i in first}


def test_a_forest_of_a_single_leaf_and_one_that_is_loaded(spark, tmp_path):
    _, train, _ = fitted(spark)
    flat = train.withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))
    model = models.train_random_forest(flat, models.small_config(rf_trees=3))
    assert {t.numNodes for t in model.trees} == {1}
    models._save_model(model, str(tmp_path / "m"))
    for kept in (model, models._load_model(spark, "rf", str(tmp_path / "m"), models.small_config())):
        assert {r["id"]: r["p"] for r in models.add_probability(kept, flat, "p").collect()} == own_probability(model, flat)


def test_claims_are_prepared_once_and_test_rows_spread(spark, sf_dir):
    assert "events.parquet" not in plan_text(learning._training(spark, sf_dir))
    _, test_rows = learning._split(spark, sf_dir)
    assert test_rows.rdd.getNumPartitions() == 8
