"""Neighbours, balancing, metrics, models and contributions."""

import json
import tracemalloc
from dataclasses import asdict, replace

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from claimsieve.catalog import base, learning
from claimsieve.learning import balance, contributions, isotonic, metrics, models, neighbors
from claimsieve.plans.pipeline import score_claim, score_claims


def points(n=400, d=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    x[: n // 3] = 0.5  # a third of all rows are copies
    return x


def frame_of(spark, x, labels=None):
    labels = labels if labels is not None else np.arange(len(x)) % 2
    return spark.createDataFrame(
        [(i, [float(v) for v in row], int(y)) for i, (row, y) in enumerate(zip(x, labels))], "id long, features array<double>, label int"
    )


def brute_force(x, k, exclude_self):
    distance = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = {}
    for i in range(len(x)):
        order = sorted((distance[i, j], j) for j in range(len(x)) if not (exclude_self and i == j))
        out[i] = [(j, round(d, 9)) for d, j in order[:k]]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("q_id", "rank").collect():
        out.setdefault(r["q_id"], []).append((r["t_id"], round(r["distance"], 9)))
    return out


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("limit", [neighbors.BROADCAST_BYTES, 0])
def test_knn_is_exact(spark, monkeypatch, exclude_self, limit):
    # Small blocks and chunks, so crowded cells are really split.
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neighbors, "CHUNK_ROWS", 30)
    x = points()
    frame = frame_of(spark, x).repartition(4)
    found = collected(neighbors.knn_join(frame, frame, 4, exclude_self=exclude_self, broadcast_bytes=limit, pivots=8))
    assert found == brute_force(x, 4, exclude_self)


def test_knn_with_fewer_rows_than_k(spark):
    x = points(3)
    frame = frame_of(spark, x)
    for limit in (10**6, 0):
        found = collected(neighbors.knn_join(frame, frame, 7, exclude_self=True, broadcast_bytes=limit))
        assert found == brute_force(x, 7, True)


def clusters(n=3000, d=10, seed=2):
    """Points near a surface of few dimensions, as scaled claim features are."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 3)) @ rng.normal(size=(3, d)) + 0.05 * rng.normal(size=(n, d)) + 4 * rng.integers(0, 3, size=(n, 1))


def test_bounds_hold_and_close_most_cells(spark):
    x = clusters()
    frame = frame_of(spark, x).repartition(4)
    index = neighbors.index_rows(frame, 6)
    lower, _ = index.lower_bounds(x[:200])
    cell = {r["t_id"]: r["cell"] for r in index.cells.select("t_id", "cell").collect()}
    owner = np.array([cell[i] for i in range(len(x))])
    distance = np.sqrt(((x[:200, None] - x[None]) ** 2).sum(-1))
    for c in np.unique(owner):
        assert (lower[:, c] <= distance[:, owner == c].min(axis=1) + 1e-6).all()
    found = collected(neighbors.knn_join(frame.where("id < 200"), index, 5, exclude_self=True))
    order = np.lexsort((np.tile(np.arange(len(x)), (200, 1)), np.where(np.arange(200)[:, None] == np.arange(len(x)), np.inf, distance)), axis=1)[:, :5]
    assert {q: [t for t, _ in hits] for q, hits in found.items()} == {q: order[q].tolist() for q in range(200)}
    # The first round visits one cell per query; all rounds together less than half of all pairs.
    assert index.visits[0] == 200 and sum(index.visits) < 0.5 * 200 * len(index.pivots)


def test_where_no_bound_holds_a_vector_goes_to_blocks_not_cells(spark, monkeypatch):
    # Points spread evenly over a sphere: every query has to see all rows.
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 200)
    x = np.random.default_rng(4).normal(size=(1000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = neighbors.index_rows(frame_of(spark, x), 6)
    found = collected(neighbors.knn_join(frame_of(spark, x), index, 5, exclude_self=True))
    assert found == brute_force(x, 5, True)
    shelf = index.shelves()
    assert len(index.pivots) > 30 and shelf.max() < 10 and all(index.size[shelf == s].sum() <= 200 for s in range(shelf.max() + 1))
    assert sum(index.visits) <= 1000 * (shelf.max() + 1)


def test_a_search_moves_every_vector_a_fixed_number_of_times(spark, monkeypatch):
    """Four times as many shelves, none of which a bound closes: each vector is written as often as before."""
    x = np.random.default_rng(9).normal(size=(800, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index, joined, store = neighbors.index_rows(frame_of(spark, x), 2), [], neighbors.stored

    def watch(df, name, *rest):
        joined.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return store(df, name, *rest)

    monkeypatch.setattr(neighbors, "stored", watch)
    rows = []
    for size in (400, 100):
        monkeypatch.setattr(neighbors, "BLOCK_ROWS", size)
        monkeypatch.setattr(neighbors, "CHUNK_ROWS", size)
        joined.clear()
        found = collected(neighbors.knn_join(frame_of(spark, x), index, 1, exclude_self=True))
        assert found == brute_force(x, 1, True)
        rows.append([name for name, _ in joined])
    assert rows[0] == rows[1] == ["knn-asked", "knn-begun", "knn-best"]
    # Chunks meet blocks where they are read, not in a shuffle of copies.
    plan = dict(joined)["knn-best"]
    assert "CartesianProduct" in plan and "FlatMapCoGroupsInPandas" not in plan and "Generate explode" not in plan


def test_a_reach_shortens_the_list_but_not_the_result():
    x = points(300)
    ids = np.arange(300)
    plain = neighbors.nearest_in_block(ids[:50], x[:50], ids, x, 4, True)
    reach = plain.groupby("q_id")["distance"].max().to_numpy()
    assert neighbors.nearest_in_block(ids[:50], x[:50], ids, x, 4, True, reach).equals(plain)


def test_a_saved_index_answers_as_before(spark, tmp_path, monkeypatch):
    x = clusters(600)
    frame = frame_of(spark, x)
    config = models.LearningConfig(knn_k=5)
    model = models.train_knn(frame, config, broadcast_bytes=0)
    assert model.index is not None and models.train_knn(frame, config).index is None
    models._save_model(model, str(tmp_path / "m"))
    queries = frame_of(spark, clusters(50, seed=3))
    before = {r["id"]: r["p"] for r in models.add_probability(model, queries, "p").collect()}

    def refuse(*_):
        raise AssertionError("rows are dealt to cells again")

    monkeypatch.setattr(neighbors, "build_index", refuse)
    loaded = models._load_model(spark, "knn", str(tmp_path / "m"), config)
    after = {r["id"]: r["p"] for r in models.add_probability(loaded, queries, "p").collect()}
    plain = {r["id"]: r["p"] for r in models.add_probability(models.train_knn(frame, config), queries, "p").collect()}
    assert after == pytest.approx(before) and after == pytest.approx(plain)
    links = {tuple(r) for r in balance.tomek_links(frame, index=loaded.index).collect()}
    assert links == {tuple(r) for r in balance.tomek_links(frame).collect()}


def test_an_index_with_too_few_copies_is_refused(spark):
    frame = frame_of(spark, points(50))
    index = neighbors.index_rows(frame, 3)
    with pytest.raises(ValueError, match="too few"):
        neighbors.knn_join(frame, index, 3, exclude_self=True)
    empty = neighbors.index_rows(frame.where("false"), 3)
    assert neighbors.knn_join(frame, empty, 2).count() == 0
    assert neighbors.knn_join(frame.where("false"), index, 2).count() == 0


def test_knn_probability_zero_distance_decides(spark):
    train = spark.createDataFrame([(0, [0.0], 1), (1, [0.0], 0), (2, [1.0], 1), (3, [4.0], 0)], "id long, features array<double>, label int")
    queries = spark.createDataFrame([(10, [0.0]), (11, [2.0])], "id long, features array<double>")
    found = {r["q_id"]: r["probability"] for r in neighbors.knn_probability(queries, train, 4).collect()}
    assert found[10] == 0.5
    assert found[11] == pytest.approx((1 / 2 + 1 / 1) / (1 / 2 + 1 / 2 + 1 / 1 + 1 / 2))


@pytest.mark.parametrize("parts", [1, 5, 70])
def test_isotonic_pools_merge_to_the_same_map(spark, parts):
    rng = np.random.default_rng(parts)
    score = np.round(rng.random(2000), 3)
    label = (rng.random(2000) < 0.2 + 0.5 * score**2).astype(int)
    scored = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "_score double, label int").repartition(4)
    found = isotonic.fit_isotonic(scored, parts=parts)
    points = scored.groupBy("_score").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    plain = IsotonicRegression(featuresCol="_score", labelCol="label", weightCol="weight").fit(points)
    assert np.allclose(found.boundaries.toArray(), plain.boundaries.toArray())
    assert np.allclose(found.predictions.toArray(), plain.predictions.toArray())


def test_isotonic_map_is_bounded_and_rises(spark):
    # Every point is a block of its own.
    scored = spark.range(5000).selectExpr("id / 5000D AS _score", "id / 5000D AS label")
    points = scored.selectExpr("_score AS score", "label", "1D AS weight")
    blocks = isotonic.pooled_blocks(points, parts=20, most=64).orderBy("low").collect()
    assert len(blocks) <= 64 and sum(b["weight"] for b in blocks) == 5000
    assert all(a["high"] < b["low"] and a["mean"] < b["mean"] for a, b in zip(blocks, blocks[1:]))
    model = isotonic.fit_isotonic(scored.withColumn("label", F.col("label")), parts=20, most=64)
    assert len(model.boundaries) <= 128
    away = model.setFeaturesCol("_score").setPredictionCol("p").transform(scored).agg(F.max(F.abs(F.col("p") - F.col("label")))).first()[0]
    assert away < 2 / 64
    one = spark.createDataFrame([(0.5, 1)], "_score double, label int")
    assert isotonic.fit_isotonic(one).predictions.toArray().tolist() == [1.0]


def test_fold_scores_against_a_plain_count(spark, monkeypatch):
    frame = frame_of(spark, points(240, seed=5), (np.arange(240) % 3 == 0).astype(int))
    config = models.LearningConfig(validation_folds=3, knn_k=3)
    kept, add = [], models.add_probability

    def watch(model, rows, output):
        scored = add(model, rows, output)
        kept.extend(scored.select("fold", "label", output).collect())
        return scored

    monkeypatch.setattr(models, "add_probability", watch)
    found = {r["fold"]: r for r in models.fold_scores(frame, ("knn",), config).collect()}
    assert sum(r["rows"] for r in found.values()) == 240 and set(found) == {0, 1, 2}
    for fold, r in found.items():
        pairs = [(x["probability"] > 0.5, x["label"] == 1) for x in kept if x["fold"] == fold]
        counts = (pairs.count((True, True)), pairs.count((True, False)), pairs.count((False, True)))
        assert (r["hits"], r["false_alarms"], r["missed"]) == counts
        assert r["f1"] == pytest.approx(2 * counts[0] / max(1, 2 * counts[0] + counts[1] + counts[2]))
    mean = models.cross_validate(frame, ("knn",), config).first()["cv_f1"]
    assert mean == pytest.approx(np.mean([r["f1"] for r in found.values()]))


def test_importances_are_the_trees_means(spark):
    frame = frame_of(spark, points(200, seed=6), (points(200, seed=6)[:, 1] > 0.2).astype(int))
    config = models.small_config(rf_trees=5)
    forest, boosted = models.train_random_forest(frame, config), models.train_boosting(frame, config)
    found = models.feature_importance({"rf": forest, "lgb": boosted, "knn": None}, ["a", "b", "c"])
    shares = [m.featureImportances.toArray() / m.featureImportances.toArray().sum() for m in (forest, boosted)]
    assert list(found.values()) == pytest.approx(np.mean(shares, axis=0).tolist())
    assert max(found, key=found.get) == "b"


def test_smote_reaches_parity_between_neighbours(spark):
    x = points(150, seed=3)
    labels = (np.arange(150) % 5 == 0).astype(int)
    out = balance.smote(frame_of(spark, x, labels))
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 120, 1: 120}
    assert out.select("id").distinct().count() == 240
    minority = x[labels == 1]
    for r in out.where("synthetic = 1").collect():
        p = np.array(r["features"])
        assert (p >= minority.min(0) - 1e-9).all() and (p <= minority.max(0) + 1e-9).all()
    again = balance.smote(frame_of(spark, x, labels).repartition(5))
    assert {tuple(r) for r in again.selectExpr("id", "features[0]").collect()} == {tuple(r) for r in out.selectExpr("id", "features[0]").collect()}


def test_tomek_links(spark):
    x = points(120, seed=5)
    labels = (np.arange(120) % 3 == 0).astype(int)
    near = {i: v[0][0] for i, v in brute_force(x, 1, True).items()}
    expected = {(i, j) for i, j in near.items() if i < j and near[j] == i and labels[i] != labels[j]}
    frame = frame_of(spark, x, labels)
    assert {tuple(r) for r in balance.tomek_links(frame).collect()} == expected
    kept = {r["id"] for r in balance.remove_tomek_links(frame).collect()}
    assert kept == set(range(120)) - {i for pair in expected for i in pair}


def test_pseudo_labels_fall_back_to_the_top_tenth(spark):
    some = spark.createDataFrame([(80.0, "a, b, c"), (80.0, "a, b"), (60.0, "a, b, c")], "risk_score double, triggered_rules string")
    assert [r["label"] for r in balance.pseudo_labels(some).collect()] == [1, 0, 0]
    none = spark.createDataFrame([(float(i), "a") for i in range(11)], "risk_score double, triggered_rules string")
    assert [r["risk_score"] for r in balance.pseudo_labels(none).where("label = 1").collect()] == [10.0]


def test_metrics_edges(spark):
    frame = spark.createDataFrame([(0.9, 1), (0.4, 0), (0.4, 1), (0.1, 0)], "probability double, label int")
    assert metrics.roc_auc(frame).first()[0] == pytest.approx(0.875)
    assert metrics.average_precision(frame).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    ones = frame.where("label = 1")
    assert metrics.roc_auc(ones).first()[0] == 0.5 and metrics.average_precision(ones).first()[0] == 0.5
    assert metrics.classification_metrics(frame.where("label = 0")).first()["recall"] == 0


def test_logistic_matches_a_direct_solution(spark):
    """The penalised balanced loss, minimised by Newton steps."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + rng.normal(size=200) > 0.8).astype(int)
    model = models.train_logistic(frame_of(spark, x, y))
    weight = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (1 - y).sum()))
    design, theta = np.c_[x, np.ones(200)], np.zeros(3)
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ theta))
        gradient = 0.1 * design.T @ (weight * (p - y)) + penalty @ theta
        hessian = 0.1 * (design * (weight * p * (1 - p))[:, None]).T @ design + penalty
        theta -= np.linalg.solve(hessian, gradient)
    assert [*model.coefficients.toArray(), model.intercept] == pytest.approx(list(theta), abs=1e-3)


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    frame = base.ruled(spark, sf_dir)
    return balance.pseudo_labels(frame)


@pytest.fixture(scope="module")
def ensemble(labelled):
    config = models.small_config(members=("lr", "rf", "knn"), rf_trees=8, calibration_folds=2)
    return models.train_ensemble(labelled, config=config)


def test_ensemble_predicts_probabilities(spark, labelled, ensemble):
    found = ensemble.predict(labelled)
    assert found.count() == labelled.count()
    low, high, gaps = found.agg(F.min("ml_fraud_prob"), F.max("ml_fraud_prob"), F.count_if(F.col("ml_fraud_prob").isNull())).first()
    assert 0 <= low < high <= 1 and gaps == 0
    # The label also depends on the police report, which is no model feature: clearly
    # better than chance is all that can be expected of held-out rows.
    assert ensemble.metrics["roc_auc"] > 0.65 and set(ensemble.metrics["individual"]) == {"lr_f1", "rf_f1", "knn_f1"}
    assert sum(ensemble.importances.values()) == pytest.approx(1.0)
    members = ensemble.member_probabilities(ensemble.vectors(labelled))
    assert members.where("abs(p_lr - p_rf) > 0.01").count() > 0


def test_predicting_is_spread_over_tasks(spark, labelled, ensemble):
    forest = models.Ensemble(ensemble.features, ensemble.scale, {"rf": ensemble.members["rf"]}, {}, ensemble.config)
    assert forest.predict(labelled).select(F.spark_partition_id()).distinct().count() == 8


def test_one_claim_scores_as_in_the_batch(spark, labelled, ensemble):
    batch = ensemble.predict(labelled).orderBy("row_idx").first()
    alone = ensemble.predict(labelled.where(F.col("row_idx") == batch["row_idx"])).first()
    assert alone["ml_fraud_prob"] == pytest.approx(batch["ml_fraud_prob"], abs=1e-9)


def test_models_survive_storage(spark, labelled, ensemble, tmp_path):
    ensemble.save(spark, str(tmp_path / "m"))
    loaded = models.Ensemble.load(spark, str(tmp_path / "m"))
    before = {r["row_idx"]: r["ml_fraud_prob"] for r in ensemble.predict(labelled).collect()}
    after = {r["row_idx"]: r["ml_fraud_prob"] for r in loaded.predict(labelled).collect()}
    assert before == pytest.approx(after)
    assert loaded.metrics["roc_auc"] == ensemble.metrics["roc_auc"]


def test_scoring_with_a_model(spark, sf_dir, ensemble):
    from claimsieve.fixtures import claims_raw

    scored = score_claims(claims_raw(spark, sf_dir), predict=ensemble.predict)
    assert scored.where("ml_fraud_probability IS NULL OR explanation NOT LIKE '%Machine learning%' AND ml_fraud_probability > 0").count() == 0
    one = score_claim(spark, {"claim_id": "x", "total_claim_amount": 9000, "incident_hour_of_the_day": 3}, ensemble.predict)
    assert one.first()["final_risk_score"] > 0


def test_too_little_data_trains_nothing(labelled):
    assert models.train_ensemble(labelled.orderBy("row_idx").limit(20), config=models.small_config(members=("lr",))) is None


def test_contributions(spark):
    frame = spark.createDataFrame([("c1", 300000.0, 20.0, "theft", 0.9)], "claim_id string, total_claim_amount double, age double, kind string, probability double")
    importances = {"total_claim_amount": 0.5, "age": 0.3, "kind": 0.2, "absent": 0.1}
    found = contributions.explain_predictions(frame, importances).first()
    values = {c["feature"]: c["contribution"] for c in found["contributions"]}
    assert values == pytest.approx({"age": 0.3 * (20 - 49) / 31 * 0.4, "kind": 0.2 * 0.4, "total_claim_amount": 0.5 * 0.2 * 0.4})
    assert [c["feature"] for c in found["contributions"]] == ["age", "kind", "total_claim_amount"]
    assert [c["feature"] for c in found["top_positive"]] == ["Kind", "Total Claim Amount"]
    assert found["explanation_text"].startswith("Claim c1 has a fraud probability of 90.0%, which is significantly higher than the baseline (50.0%)")
    assert "  • Age: -0.112 impact" in found["explanation_text"]
    assert contributions.mean_importance([[2.0, 2.0], [0.0, 1.0]], ["a", "b"]) == {"a": 0.25, "b": 0.75}
    assert contributions.mean_importance([], ["a", "b"]) == {"a": 0.5, "b": 0.5}
    assert contributions.top_importance({"unusual_hour": 0.1, "age": 0.9}, 1) == [("Age", 0.9)]


def test_dealing_rows_to_cells_keeps_its_memory():
    rng = np.random.default_rng(2)
    x, pivots = rng.normal(size=(4000, 16)), rng.normal(size=(4096, 16))
    tracemalloc.start()
    cell, away = neighbors._nearest_pivot(x, pivots)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All rows at once would take 131 MB for one matrix of distances.
    assert peak < 32e6
    exact = np.sqrt(((x[:200, None] - pivots[None]) ** 2).sum(axis=2))
    assert (cell[:200] == exact.argmin(axis=1)).all() and np.allclose(away[:200], exact.min(axis=1))


def test_few_rows_are_brought_in_for_the_fit(spark):
    rows = spark.range(3000).selectExpr("id AS t_id", "array(CAST(id % 1000 AS DOUBLE), 1D) AS t_vec")
    hashes = [tuple(r[0]) for r in rows.select("t_vec").distinct().orderBy(F.xxhash64("t_vec")).collect()]
    # Copies make the first share too small for 900; there are no 1,100 distinct vectors.
    for wanted in (10, 900, 1100):
        assert [tuple(v) for v in neighbors._lowest_hashes(rows, wanted, 3000)] == hashes[:wanted]


@pytest.fixture(scope="module")
def many_events(spark, tmp_path_factory):
    """Three thousand events, more than the thousand rows that model queries were once fitted on."""
    path = tmp_path_factory.mktemp("events")
    spark.range(3000).selectExpr(
        "id AS event_id", "id % 150 AS user_id", "timestamp_seconds(1700000000 + id * 977) AS ts", "element_at(array('error', 'click', 'view'), CAST(id % 3 AS INT) + 1) AS event_type",
        "CAST(id * 37 % 1009 AS DOUBLE) / 2 AS value", """concat('{"k": ', id * 7 % 100, '}') AS props""",
    ).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_members_are_fitted_on_all_training_rows(spark, many_events):
    train, test = learning._split(spark, many_events)
    claims = base.prepared(spark, many_events).count()
    assert train.count() + test.count() == claims and train.count() > 0.79 * claims


def test_the_ensemble_is_fitted_on_all_labelled_rows(spark, many_events, monkeypatch):
    """The linear member alone, as the other fits see the same rows."""
    fit, train, seen = models.fit_member, models.train_ensemble, []

    def watch(name, frame, config):
        seen.append(frame.count())
        return fit(name, frame, config)

    def light(df, config, features):
        return train(df, config=replace(config, members=("lr",), calibration_folds=2), features=features)

    monkeypatch.setattr(models, "fit_member", watch)
    monkeypatch.setattr(models, "train_ensemble", light)
    monkeypatch.setattr(learning, "_ENSEMBLES", {})
    frame, ensemble = learning._ensemble(spark, many_events)
    claims = frame.count()
    assert ensemble.metrics["n_samples"] == pytest.approx(0.2 * claims, abs=2)
    # The balanced rows, of which few are ends of links; then what two folds leave each other.
    balanced, *halves = seen
    assert balanced > 0.8 * claims and sum(halves) == claims - ensemble.metrics["n_samples"]


def test_neighbours_keep_all_training_rows(spark):
    rows = spark.range(250_000).selectExpr("id", "array(CAST(id AS DOUBLE)) AS features", "CAST(id % 2 AS INT) AS label")
    assert models.train_knn(rows).rows.count() == 250_000


def test_models_stored_with_former_settings_are_read(spark, labelled, tmp_path):
    model = models.train_ensemble(labelled, config=models.small_config(members=("lr",)), with_calibration=False)
    former = {**asdict(model.config), "label_rows": 1000, "knn_rows": 200_000}
    model.save(spark, str(tmp_path / "m"))
    facts = json.loads(spark.read.schema("facts string").json(f"{tmp_path}/m/facts").first()["facts"])
    spark.createDataFrame([(json.dumps({**facts, "config": former}),)], "facts string").write.mode("overwrite").json(f"{tmp_path}/m/facts")
    assert models.Ensemble.load(spark, str(tmp_path / "m")).config == model.config
