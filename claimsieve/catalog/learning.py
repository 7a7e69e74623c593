"""Queries of the learning operators.

Vector operators run on the whole ``embeddings`` table, model operators on all
prepared claims, for the fit as well. SQL can't predict a fitted value, so
they return what must hold for it next to what SQL knows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import claims_raw, table
from ..learning import balance, contributions, metrics, models, neighbors
from ..operators.views import normalize_fraud_label
from ..plans.pipeline import score_claims
from ..schema import MODEL_FEATURES
from ..session import scratch_path, stored
from .base import PREPARED, PROBABILITY, RULED, oracle, prepared, query, ruled, with_probability


# --- labels, split, scaling --------------------------------------------------
LABEL_SQL = "CASE WHEN lower(trim(fraud_reported)) = 'yes' THEN 1 ELSE 0 END"


def _labelled(frame):
    return frame.withColumn("label", F.when(normalize_fraud_label(F.col("fraud_reported")) == "Y", 1).otherwise(0))


@query(
    "pseudo_labels",
    oracle(
        RULED,
        """SELECT row_idx, CAST(CASE WHEN (SELECT count(*) FROM ruled WHERE risk_score > 70 AND len(indicators) >= 3) > 0
  THEN risk_score > 70 AND len(indicators) >= 3
  ELSE risk_score > (SELECT quantile_cont(risk_score, 0.9) FROM ruled) END AS BIGINT) AS label FROM ruled""",
    ),
)
def pseudo_labels(spark, sf_dir):
    return balance.pseudo_labels(ruled(spark, sf_dir)).select("row_idx", "label")


@query(
    "training_guard",
    oracle(
        PREPARED,
        f"SELECT count(*) AS n_rows, count(*) FILTER ({LABEL_SQL} = 1) AS n_positive, count(*) >= 50 AND count(*) FILTER ({LABEL_SQL} = 1) >= 5 AS trainable FROM prepared",
    ),
)
def training_guard(spark, sf_dir):
    return balance.training_guard(_labelled(prepared(spark, sf_dir)))


SPLIT = f"""{PREPARED},
labelled AS (SELECT *, {LABEL_SQL} AS label FROM prepared),
hashed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_idx AS VARCHAR))) AS rn, count(*) OVER (PARTITION BY label) AS nl FROM labelled),
split AS (SELECT *, rn <= floor(CAST(0.2 AS DOUBLE) * nl) AS is_test,
  (rn > floor(CAST(0.2 AS DOUBLE) * nl))::INT + (rn > floor(CAST(0.4 AS DOUBLE) * nl))::INT
  + (rn > floor(CAST(0.6 AS DOUBLE) * nl))::INT + (rn > floor(CAST(0.8 AS DOUBLE) * nl))::INT AS fold FROM hashed)"""


@query("stratified_split", oracle(SPLIT, "SELECT row_idx, CAST(label AS BIGINT) AS label, CAST(is_test AS BIGINT) AS is_test FROM split"))
def stratified_split(spark, sf_dir):
    return balance.stratified_split(_labelled(prepared(spark, sf_dir)).select("row_idx", "label"), "row_idx")


@query("stratified_folds", oracle(SPLIT, "SELECT row_idx, CAST(label AS BIGINT) AS label, CAST(fold AS BIGINT) AS fold FROM split"))
def stratified_folds(spark, sf_dir):
    return balance.stratified_folds(_labelled(prepared(spark, sf_dir)).select("row_idx", "label"), "row_idx", 5)


SCALED = ["total_claim_amount", "incident_hour_of_the_day", "age", "amount_per_age"]


@query(
    "standardize",
    oracle(
        SPLIT,
        "SELECT row_idx, "
        + ", ".join(f"round(({c} - (SELECT avg({c}) FROM split WHERE NOT is_test)) / (SELECT stddev_pop({c}) FROM split WHERE NOT is_test), 6) AS {c}" for c in SCALED)
        + " FROM split",
    ),
)
def standardize(spark, sf_dir):
    frame = _labelled(prepared(spark, sf_dir)).select("row_idx", "label", *SCALED)
    train = balance.stratified_split(frame, "row_idx").where("is_test = 0")
    return balance.standardize(frame, SCALED, train).select("row_idx", *SCALED)


# --- neighbours and balancing on the embeddings ------------------------------
VECTORS = "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS id", "CAST(embedding AS array<double>) AS features", "IF(label = 0, 1, 0) AS label"
    )


PAIRS = f"""{VECTORS},
ranked AS MATERIALIZED (
  SELECT a.vec_id AS q_id, b.vec_id AS t_id, list_distance(a.v, b.v) AS distance, a.label AS q_label, b.label AS t_label,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id)"""


@query("knn_join", oracle(PAIRS, "SELECT q_id, t_id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 5"))
def knn_join(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return neighbors.knn_join(vectors, vectors, 5, exclude_self=True)


@query("knn_join_partitioned", oracle(PAIRS, "SELECT q_id, t_id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 5"))
def knn_join_partitioned(spark, sf_dir):
    # The way taken when the reference side is too large to broadcast.
    vectors = _vectors(spark, sf_dir)
    return neighbors.knn_join(vectors, vectors, 5, exclude_self=True, broadcast_bytes=0, pivots=16)


@query("knn_join_index", oracle(PAIRS, "SELECT q_id, t_id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 5"))
def knn_join_index(spark, sf_dir):
    """An index that was saved and loaded."""
    vectors = _vectors(spark, sf_dir)
    path = scratch_path(spark, "index")
    neighbors.index_rows(vectors, 6).save(path)
    return neighbors.knn_join(vectors, neighbors.load_index(spark, path), 5, exclude_self=True)


@query(
    "tomek_links",
    f"""WITH {VECTORS},
nearest AS MATERIALIZED (
  SELECT a.vec_id AS id, any_value(a.label) AS label, arg_min(b.vec_id, (list_distance(a.v, b.v), b.vec_id)) AS near_id FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)
SELECT a.id AS a_id, b.id AS b_id FROM nearest a JOIN nearest b ON a.id = b.near_id AND a.near_id = b.id AND a.id < b.id AND a.label <> b.label""",
)
def tomek_links(spark, sf_dir):
    return balance.tomek_links(_vectors(spark, sf_dir))


VOTES = f"""{VECTORS},
hashed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR))) AS rn, count(*) OVER (PARTITION BY label) AS nl FROM vectors),
parts AS (SELECT *, rn <= floor(CAST(0.2 AS DOUBLE) * nl) AS is_test FROM hashed),
near AS (
  SELECT a.vec_id AS q_id, b.label, list_distance(a.v, b.v) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
  FROM parts a JOIN parts b ON a.is_test AND NOT b.is_test)"""


@query(
    "knn_probability",
    oracle(
        VOTES,
        """SELECT q_id, round(CASE WHEN min(d) = 0 THEN avg(label) FILTER (d = 0) ELSE sum(label / d) / sum(1 / d) END, 6) AS probability
FROM near WHERE rank <= 7 GROUP BY q_id""",
    ),
)
def knn_probability(spark, sf_dir):
    split = balance.stratified_split(_vectors(spark, sf_dir), "id")
    return neighbors.knn_probability(split.where("is_test = 1"), split.where("is_test = 0"), 7)


@query(
    "train_knn_votes",
    oracle(
        VOTES,
        """SELECT q_id AS id, round(CASE WHEN min(d) = 0 THEN avg(label) FILTER (d = 0) ELSE sum(label / d) / sum(1 / d) END, 6) AS probability
FROM near WHERE rank <= 7 GROUP BY q_id""",
    ),
)
def train_knn_votes(spark, sf_dir):
    """The neighbour member over an index, saved and loaded, with all rows kept."""
    split = balance.stratified_split(_vectors(spark, sf_dir), "id")
    config = models.LearningConfig()
    path = scratch_path(spark, "knn-member")
    models._save_model(models.train_knn(split.where("is_test = 0"), config, broadcast_bytes=0), path)
    model = models._load_model(spark, "knn", path, config)
    return models.add_probability(model, split.where("is_test = 1"), "probability").select("id", "probability")


SMOTE = f"""{VECTORS},
sizes AS (SELECT count(*) FILTER (label = 0) AS zeros, count(*) FILTER (label = 1) AS ones FROM vectors),
plan AS (SELECT CASE WHEN ones <= zeros THEN 1 ELSE 0 END AS minority_label, least(zeros, ones) AS minority, abs(zeros - ones) AS missing FROM sizes),
small AS (SELECT vec_id AS id, v, label, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) AS hash_rank FROM vectors WHERE label = (SELECT minority_label FROM plan)),
close AS MATERIALIZED (
  SELECT a.id, b.v AS near_v, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM small a JOIN small b ON a.id <> b.id),
quota AS (
  SELECT s.*, p.missing // p.minority AS share, least(5, p.minority - 1) AS k,
    p.missing // p.minority + (s.hash_rank <= floor(CAST(p.missing % p.minority AS DOUBLE) / p.minority * p.minority))::INT AS copies
  FROM small s CROSS JOIN plan p),
made AS (SELECT *, unnest(range(copies)) AS copy FROM quota),
chosen AS (
  SELECT m.*, 1 + CAST('0x' || substr(md5(id || ':' || copy || ':neighbour'), 1, 8) AS BIGINT) % k AS pick,
    CAST('0x' || substr(md5(id || ':' || copy || ':position'), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM made m),
oversampled AS MATERIALIZED (
  SELECT vec_id AS id, v, label, 0 AS synthetic FROM vectors
  UNION ALL SELECT -(c.id * (c.share + 1) + c.copy) - 1, list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] + c.u * (n.near_v[i] - c.v[i])), c.label, 1
  FROM chosen c JOIN close n ON n.id = c.id AND n.rank = c.pick)"""
CELLS = "unnest(range(len(v))) AS dimension, round(unnest(v), 6) AS value"


def _cells(frame, *columns):
    return frame.select(*columns, F.posexplode("features").alias("dimension", "value"))


@query("smote", oracle(SMOTE, f"SELECT id, CAST(label AS BIGINT) AS label, CAST(synthetic AS BIGINT) AS synthetic, {CELLS} FROM oversampled"))
def smote(spark, sf_dir):
    return _cells(balance.smote(_vectors(spark, sf_dir)), "id", "label", "synthetic")


@query(
    "smote_counts",
    oracle(
        VECTORS,
        "SELECT CAST(label AS BIGINT) AS label, greatest((SELECT count(*) FROM vectors WHERE label = 0), (SELECT count(*) FROM vectors WHERE label = 1)) AS n FROM vectors GROUP BY label",
    ),
)
def smote_counts(spark, sf_dir):
    return balance.smote(_vectors(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "smote_tomek",
    oracle(
        SMOTE,
        f"""SELECT id, CAST(label AS BIGINT) AS label, {CELLS} FROM oversampled WHERE id NOT IN (
  SELECT unnest([a.id, a.near_id]) FROM nearest a JOIN nearest b ON a.id = b.near_id AND a.near_id = b.id AND a.id < b.id AND a.label <> b.label)""",
    ).replace(
        "\nSELECT id,",
        """,
nearest AS MATERIALIZED (
  SELECT a.id, a.label, arg_min(b.id, (list_distance(a.v, b.v), b.id)) AS near_id FROM oversampled a JOIN oversampled b ON a.id <> b.id GROUP BY a.id, a.label)
SELECT id,""",
        1,
    ),
)
def smote_tomek(spark, sf_dir):
    return _cells(balance.smote_tomek(_vectors(spark, sf_dir)), "id", "label")


# --- models ------------------------------------------------------------------
#: Model queries fit on all labelled rows and score all claims. Settings are the library defaults, but for the two
#: boosted members: 200 rounds of depth 8 take Spark over five minutes a fit even on 1,000 rows, so queries run fewer.
FULL = models.LearningConfig(boost_rounds=10, boost_depth=4)
NAMES = FULL.members


def _training(spark, sf_dir):
    """All prepared claims as vectors, standardised with the moments of the training rows, and the reported label."""
    frame = _labelled(prepared(spark, sf_dir)).select("row_idx", "label", *[F.col(c).cast("double") for c in MODEL_FEATURES])
    frame = stored(frame, "claims")  # The cuts of the split, the moments and the rows are passes of their own.
    split = balance.stratified_split(frame, "row_idx")
    scaled = balance.standardize(split, MODEL_FEATURES, split.where("is_test = 0"))
    return scaled.select(F.col("row_idx").alias("id"), "label", "is_test", F.array(*MODEL_FEATURES).alias("features"))


def _split(spark, sf_dir):
    split = stored(_training(spark, sf_dir), "split", "id")
    train = split.where("is_test = 0").drop("is_test")
    # A given number of tasks, as in Ensemble.member_probabilities: a small row is much work for a forest.
    test = split.where("is_test = 1").drop("is_test").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return train, test


IN_RANGE = "probability BETWEEN 0 AND 1 AS in_range"
TEST_ROWS = "SELECT row_idx AS id, CAST(label AS BIGINT) AS label, {checks} FROM split WHERE is_test"


def _member(name, member):
    @query(name, oracle(SPLIT, TEST_ROWS.format(checks="true AS in_range, true AS varies")))
    def build(spark, sf_dir):
        train_rows, test_rows = _split(spark, sf_dir)
        found = models.add_probability(models.fit_member(member, train_rows, FULL), test_rows, "probability")
        found = stored(found.select("id", "label", "probability"), name)
        varies = found.agg((F.max("probability") - F.min("probability") > 0.01).alias("v")).scalar()
        return found.withColumn("varies", varies).selectExpr("id", "label", IN_RANGE, "varies")


for _name, _key in {"train_random_forest": "rf", "train_knn": "knn", "train_boosting": "lgb", "train_boosting_weighted": "xgb"}.items():
    _member(_name, _key)


@query("train_logistic", oracle(SPLIT, TEST_ROWS.format(checks="true AS in_range, true AS at_optimum")))
def train_logistic(spark, sf_dir):
    """At the optimum the gradient of the penalised, weighted loss is zero in every direction."""
    train_rows, test_rows = _split(spark, sf_dir)
    model = models.train_logistic(train_rows, FULL)
    fitted = models.add_probability(model, train_rows, "probability")
    counts = fitted.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    weight = F.when(F.col("label") == 1, counts["n"] / (2.0 * counts["p"])).otherwise(counts["n"] / (2.0 * (counts["n"] - counts["p"])))
    residual = weight * (F.col("probability") - F.col("label")) / counts["n"]
    beta, penalty = model.coefficients.toArray(), 1.0 / (FULL.lr_c * counts["n"])
    gradient = [F.abs(F.sum(residual * F.col("features")[i]) + float(penalty * b)) for i, b in enumerate(beta)] + [F.abs(F.sum(residual))]
    optimum = fitted.agg((F.greatest(*gradient) < 1e-4).alias("g")).scalar()
    found = models.add_probability(model, test_rows, "probability").withColumn("at_optimum", optimum)
    return found.selectExpr("id", "label", IN_RANGE, "at_optimum")


def _calibrated(member):
    @query(f"calibrate_{member}", oracle(SPLIT, TEST_ROWS.format(checks=f"{FULL.calibration_folds} AS folds, true AS in_range, true AS monotone")))
    def build(spark, sf_dir):
        train_rows, test_rows = _split(spark, sf_dir)
        calibrated = models.calibrate(member, train_rows, FULL)
        maps = [pair[1] for pair in calibrated.pairs]
        rising = all((m.predictions.toArray()[1:] >= m.predictions.toArray()[:-1]).all() for m in maps)
        found = calibrated.add(test_rows, "probability")
        return found.selectExpr("id", "label", f"{len(maps)}L AS folds", IN_RANGE, f"{str(rising).lower()} AS monotone")

    @query(f"cross_validate_{member}", f"SELECT '{member}' AS model, true AS in_range")
    def validated(spark, sf_dir):
        train_rows, _ = _split(spark, sf_dir)
        return models.cross_validate(train_rows, (member,), FULL).selectExpr("model", "cv_f1 BETWEEN 0 AND 1 AS in_range")


for _key in NAMES:
    _calibrated(_key)


@query("fold_scores")
def fold_scores(spark, sf_dir):
    """Counts and F1 of every fold; SQL can't fit a member, so there is no oracle."""
    train_rows, _ = _split(spark, sf_dir)
    return models.fold_scores(train_rows, ("lr", "knn"), FULL)


_ENSEMBLES: dict = {}


def _ensemble(spark, sf_dir):
    """All five members with their calibration, fitted once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENSEMBLES:
        _ENSEMBLES[key] = models.train_ensemble(_labelled(prepared(spark, sf_dir)), config=FULL, features=MODEL_FEATURES)
    return _labelled(prepared(spark, sf_dir)), _ENSEMBLES[key]


@query("ensemble_predict", oracle(PREPARED, "SELECT row_idx, true AS in_range, true AS blended FROM prepared"))
def ensemble_predict(spark, sf_dir):
    """Every claim's probability is the weighted sum of its five calibrated members."""
    frame, ensemble = _ensemble(spark, sf_dir)
    members = ensemble.member_probabilities(ensemble.vectors(frame.select("row_idx", *MODEL_FEATURES)))
    apart = stored(members.select("row_idx", *[f"p_{n}" for n in NAMES]), "members")
    together = ensemble.predict(frame.select("row_idx", *MODEL_FEATURES)).withColumnRenamed("ml_fraud_prob", "probability")
    shares = {n: w for n, w in models.weights_for(NAMES).items()}
    total = " + ".join(f"{w!r}D * p_{n}" for n, w in shares.items())
    joined = together.join(apart, "row_idx")
    return joined.selectExpr("row_idx", IN_RANGE, f"abs(probability - ({total})) < 1e-9 AS blended")


@query("score_claims_with_model", oracle(RULED, "SELECT row_idx, claim_id, round(risk_score, 6) AS rule_score, true AS blended, true AS banded, true AS explained FROM ruled"))
def score_claims_with_model(spark, sf_dir):
    _, ensemble = _ensemble(spark, sf_dir)
    scored = score_claims(claims_raw(spark, sf_dir), predict=ensemble.predict)
    rules = ruled(spark, sf_dir).selectExpr("row_idx", "risk_score AS rule_score")
    joined = scored.select("row_idx", "claim_id", "final_risk_score", "risk_level", "ml_fraud_probability", "explanation").join(rules, "row_idx")
    return joined.selectExpr(
        "row_idx", "claim_id", "rule_score", "abs(final_risk_score - (0.6D * rule_score + 40D * ml_fraud_probability)) < 1e-9 AS blended",
        "risk_level = CASE WHEN final_risk_score >= 70 THEN 'High' WHEN final_risk_score >= 30 THEN 'Medium' ELSE 'Low' END AS banded",
        "ml_fraud_probability = 0 OR contains(explanation, 'Machine learning models') AS explained",
    )


@query("save_load_models", oracle(PREPARED, "SELECT row_idx, true AS same FROM prepared"))
def save_load_models(spark, sf_dir):
    """All members and calibrators answer after loading as they did before saving."""
    frame, ensemble = _ensemble(spark, sf_dir)
    path = scratch_path(spark, "models")
    ensemble.save(spark, path)
    before = ensemble.predict(frame.select("row_idx", *MODEL_FEATURES)).select("row_idx", "ml_fraud_prob")
    after = models.Ensemble.load(spark, path).predict(frame.select("row_idx", *MODEL_FEATURES)).selectExpr("row_idx", "ml_fraud_prob AS loaded")
    return stored(before, "before").join(stored(after, "after"), "row_idx").selectExpr("row_idx", "abs(ml_fraud_prob - loaded) < 1e-12 AS same")


@query(
    "feature_importance",
    oracle(PREPARED, " UNION ALL ".join(f"SELECT '{c}' AS feature, round(stddev_pop({c}), 6) AS spread, true AS normalised FROM prepared" for c in MODEL_FEATURES)),
)
def feature_importance(spark, sf_dir):
    """Importances of the fitted trees next to the spread of each feature over all claims."""
    _, ensemble = _ensemble(spark, sf_dir)
    found = ensemble.importances
    normal = str(abs(sum(found.values()) - 1) < 1e-9 and min(found.values()) >= 0).lower()
    spread = prepared(spark, sf_dir).agg(*[F.stddev_pop(c).alias(c) for c in MODEL_FEATURES])
    rows = ", ".join(f"named_struct('feature', '{c}', 'spread', `{c}`, 'normalised', {normal})" for c in MODEL_FEATURES)
    return spread.selectExpr(f"inline(array({rows}))")


@query("importance_values")
def importance_values(spark, sf_dir):
    """The importances themselves, largest first; SQL can't fit a tree, so there is no oracle."""
    _, ensemble = _ensemble(spark, sf_dir)
    rows = sorted(ensemble.importances.items(), key=lambda item: (-item[1], item[0]))
    return spark.createDataFrame([(i, f, float(v)) for i, (f, v) in enumerate(rows, 1)], "rank int, feature string, importance double")


@query(
    "explain_fitted",
    oracle(PREPARED, f"SELECT row_idx, {len(MODEL_FEATURES)} AS n_features, true AS consistent FROM prepared"),
)
def explain_fitted(spark, sf_dir):
    """Contributions of the fitted ensemble to its own predictions: importance x normalised value x (probability - 0.5)."""
    frame, ensemble = _ensemble(spark, sf_dir)
    predicted = ensemble.predict(frame).withColumnRenamed("ml_fraud_prob", "probability")
    explained = contributions.explain_predictions(predicted, ensemble.importances)
    expected = F.array(*[
        F.lit(float(ensemble.importances[f])) * contributions.normalize_feature_value(f) * (F.col("probability") - 0.5) for f in MODEL_FEATURES
    ])
    values = F.transform("contributions", lambda c: c["contribution"])
    gap = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) - F.aggregate(expected, F.lit(0.0), lambda a, x: a + x)
    return explained.select("row_idx", F.size("contributions").alias("n_features"), (F.abs(gap) < 1e-9).alias("consistent"))


MEMBERS = {"lr": "row_idx * 37 % 101", "rf": "row_idx * 53 % 97", "knn": "row_idx * 71 % 89"}
SIZES = {"lr": 101, "rf": 97, "knn": 89}


@query(
    "ensemble_weights",
    oracle(
        PREPARED,
        "SELECT row_idx, round((0.35 * (row_idx * 37 % 101) / 101 + 0.40 * (row_idx * 53 % 97) / 97 + 0.25 * (row_idx * 71 % 89) / 89) / (0.35 + 0.40 + 0.25), 6) AS probability FROM prepared",
    ),
)
def ensemble_weights(spark, sf_dir):
    frame = prepared(spark, sf_dir).selectExpr("row_idx", *[f"CAST({sql} AS DOUBLE) / {SIZES[m]} AS p_{m}" for m, sql in MEMBERS.items()])
    empty = models.Ensemble([], [], dict.fromkeys(MEMBERS), {}, FULL)
    return empty.blend(frame, "probability").select("row_idx", "probability")


# --- evaluation --------------------------------------------------------------
JUDGED = f"""{PREPARED},
judged AS (SELECT row_idx, {LABEL_SQL} AS label, CAST(row_idx * 37 % 101 AS DOUBLE) / 101 AS p FROM prepared)"""


def _judged(spark, sf_dir):
    """Every claim with a stand-in probability made from the row."""
    return _labelled(prepared(spark, sf_dir)).selectExpr("row_idx", "label", "CAST(row_idx * 37 % 101 AS DOUBLE) / 101 AS probability")


@query(
    "classification_metrics",
    oracle(
        JUDGED,
        """SELECT round(avg(CAST((p > 0.5) = (label = 1) AS INTEGER)), 6) AS accuracy, round(count(*) FILTER (p > 0.5 AND label = 1) / count(*) FILTER (p > 0.5), 6) AS precision,
  round(count(*) FILTER (p > 0.5 AND label = 1) / count(*) FILTER (label = 1), 6) AS recall,
  round(2 * count(*) FILTER (p > 0.5 AND label = 1) / (count(*) FILTER (p > 0.5) + count(*) FILTER (label = 1)), 6) AS f1,
  count(*) AS n_samples, count(*) FILTER (label = 1) AS n_fraud, count(*) FILTER (label = 0) AS n_legitimate FROM judged""",
    ),
)
def classification_metrics(spark, sf_dir):
    return metrics.classification_metrics(_judged(spark, sf_dir))


@query(
    "f1_scores",
    oracle(
        JUDGED,
        """SELECT round(2 * count(*) FILTER (p > 0.5 AND label = 1) / (count(*) FILTER (p > 0.5) + count(*) FILTER (label = 1)), 6) AS a_f1,
  round(2 * count(*) FILTER (p < 0.5 AND label = 1) / (count(*) FILTER (p < 0.5) + count(*) FILTER (label = 1)), 6) AS b_f1 FROM judged""",
    ),
)
def f1_scores(spark, sf_dir):
    frame = _judged(spark, sf_dir).selectExpr("label", "probability AS a", "1 - probability AS b")
    return metrics.f1_scores(frame, ["a", "b"])


@query(
    "roc_auc",
    oracle(
        JUDGED,
        """SELECT round((sum(r) FILTER (label = 1) - CAST(count(*) FILTER (label = 1) AS DOUBLE) * (count(*) FILTER (label = 1) + 1) / 2)
  / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)), 6) AS roc_auc
FROM (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM judged)""",
    ),
)
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_judged(spark, sf_dir))


@query(
    "average_precision",
    oracle(
        JUDGED,
        """SELECT round(sum(pos * cum_pos / cum_n) / sum(pos), 6) AS average_precision
FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS cum_pos, sum(n) OVER (ORDER BY p DESC) AS cum_n
  FROM (SELECT p, CAST(sum(label) AS DOUBLE) AS pos, count(*) AS n FROM judged GROUP BY p))""",
    ),
)
def average_precision(spark, sf_dir):
    return metrics.average_precision(_judged(spark, sf_dir))


# --- contributions -----------------------------------------------------------
IMPORTANCES = {
    "total_claim_amount": 0.30,
    "incident_hour_of_the_day": 0.15,
    "age": 0.10,
    "witnesses": 0.10,
    "amount_per_age": 0.05,
    "unusual_hour": 0.05,
    "severity_numeric": 0.15,
    "incident_type": 0.10,
}
NORMALIZED = {
    "total_claim_amount": "(total_claim_amount - 250000) / 250000",
    "incident_hour_of_the_day": "(incident_hour_of_the_day - 11.5) / 11.5",
    "age": "(age - 49) / 31",
    "witnesses": "least(greatest(witnesses / 100, -1), 1)",
    "amount_per_age": "(amount_per_age - 49) / 31",
    "unusual_hour": "(unusual_hour - 11.5) / 11.5",
    "severity_numeric": "least(greatest(severity_numeric / 100, -1), 1)",
}
CONTRIBUTED = f"""{PREPARED},
predicted AS (SELECT *, coalesce({PROBABILITY}, 0.5) AS p FROM prepared),
long AS ({' UNION ALL '.join(f"SELECT row_idx, claim_id, p, '{f}' AS feature, {w!r}::DOUBLE * {NORMALIZED.get(f, '1')} * (p - 0.5) AS contribution FROM predicted" for f, w in IMPORTANCES.items())}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_idx, sign(contribution) ORDER BY abs(contribution) DESC, feature) AS rn FROM long)"""
TITLE = "array_to_string(list_transform(string_split(feature, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"


def _predicted(spark, sf_dir):
    frame = with_probability(prepared(spark, sf_dir), "_p")
    return frame.withColumn("probability", F.coalesce("_p", F.lit(0.5))).drop("_p")


@query("normalize_feature_value", oracle(PREPARED, "SELECT row_idx, " + ", ".join(f"round({sql}, 6) AS {c}" for c, sql in NORMALIZED.items()) + " FROM prepared"))
def normalize_feature_value(spark, sf_dir):
    return prepared(spark, sf_dir).select("row_idx", *[contributions.normalize_feature_value(c).alias(c) for c in NORMALIZED])


@query("feature_contributions", oracle(CONTRIBUTED, "SELECT row_idx, feature, round(contribution, 6) AS contribution FROM long"))
def feature_contributions(spark, sf_dir):
    return contributions.feature_contributions(_predicted(spark, sf_dir), IMPORTANCES, key="row_idx")


@query(
    "top_contributors",
    oracle(
        CONTRIBUTED,
        f"""SELECT row_idx, rn AS position, {TITLE} AS feature, round(contribution, 6) AS contribution,
  CASE WHEN contribution > 0 THEN 'increases' ELSE 'decreases' END AS direction FROM ranked WHERE rn <= 3 AND contribution <> 0""",
    ),
)
def top_contributors(spark, sf_dir):
    explained = contributions.explain_predictions(_predicted(spark, sf_dir), IMPORTANCES)
    both = [explained.select("row_idx", F.posexplode(side)) for side in ("top_positive", "top_negative")]
    return both[0].union(both[1]).selectExpr("row_idx", "pos + 1 AS position", "col.feature", "col.contribution", "col.direction")


def _words(options):
    return f"CASE WHEN p > 0.7 THEN '{options[0]}' WHEN p > 0.5 THEN '{options[1]}' WHEN p < 0.3 THEN '{options[2]}' ELSE '{options[3]}' END"


def _bullets(sign, mark, title):
    return (
        f"(SELECT row_idx, '{title}' || chr(10) || string_agg('  • ' || {TITLE} || ': {mark}' || printf('%.3f', round_even(abs(contribution) * 1000, 0) / 1000) || ' impact', chr(10) ORDER BY rn) AS t "
        f"FROM ranked WHERE rn <= 3 AND sign(contribution) = {sign} GROUP BY row_idx)"
    )


@query(
    "contribution_text",
    oracle(
        CONTRIBUTED,
        f"""SELECT row_idx, concat_ws(chr(10) || chr(10),
  'Claim ' || claim_id || ' has a fraud probability of ' || printf('%.1f', round_even(p * 100 * 10, 0) / 10) || '%, which is ' ||
  {_words(["significantly higher than", "slightly higher than", "significantly lower than", "near"])} || ' the baseline (50.0%), indicating ' ||
  {_words(["elevated fraud risk", "moderate fraud risk", "low fraud risk", "neutral risk"])} || '.', a.t, b.t) AS explanation_text
FROM predicted LEFT JOIN {_bullets(1, '+', 'Key factors increasing fraud likelihood:')} a USING (row_idx)
LEFT JOIN {_bullets(-1, '-', 'Key factors decreasing fraud likelihood:')} b USING (row_idx)""",
    ),
)
def contribution_text(spark, sf_dir):
    return contributions.explain_predictions(_predicted(spark, sf_dir), IMPORTANCES).select("row_idx", "explanation_text")
