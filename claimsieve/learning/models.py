"""The classifier ensemble: Spark ML members, calibration, evaluation, storage.

Training frames hold ``id, features array<double>, label``. Every member scores a
frame by adding one probability column; only the neighbour vote needs a join.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import double, with_expressions
from ..operators.features import align_features, numeric_features
from ..schema import ENSEMBLE_WEIGHTS_CORE, ENSEMBLE_WEIGHTS_FULL, ROW_INDEX
from ..session import stored
from .balance import scaling, smote, smote_tomek, stratified_folds, stratified_split, training_guard
from .contributions import mean_importance
from .forest import forest_probability
from .metrics import average_precision, classification_metrics, f1_scores, roc_auc
from .isotonic import fit_isotonic
from .neighbors import BROADCAST_BYTES, NeighborIndex, index_rows, knn_probability, load_index


@dataclass(frozen=True)
class LearningConfig:
    """Hyper-parameters; the defaults are the reference values of the model."""

    members: tuple[str, ...] = ("lr", "rf", "knn", "lgb", "xgb")
    lr_c: float = 0.1
    lr_iterations: int = 1000
    #: Relative change of the loss at which the fit ends; smaller ones only make the line search give up near the optimum.
    lr_tolerance: float = 1e-5
    rf_trees: int = 200
    rf_depth: int = 15
    rf_min_leaf: int = 2
    knn_k: int = 7
    boost_rounds: int = 200
    boost_rate: float = 0.05
    boost_depth: int = 8
    row_share: float = 0.8
    column_share: str = "0.8"
    positive_factor: float = 3.0
    calibration_folds: int = 3
    validation_folds: int = 5
    seed: int = 42
    #: Independent fits that run at the same time.
    fit_threads: int = 8


def fit_together(jobs: list, spark: SparkSession, threads: int) -> list:
    """Results of independent fits, in order; each mostly waits for small Spark jobs of its own."""
    with ThreadPool(max(1, min(threads, len(jobs)))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs])


def weights_for(members: tuple[str, ...]) -> dict[str, float]:
    """Ensemble weights of the present members, scaled to sum to 1."""
    table = ENSEMBLE_WEIGHTS_FULL if {"lgb", "xgb"} & set(members) else ENSEMBLE_WEIGHTS_CORE
    total = sum(table[m] for m in members)
    return {m: table[m] / total for m in members}


def _weighted(frame: DataFrame, positive: Column | float, negative: Column | float) -> DataFrame:
    return frame.select(
        "id",
        array_to_vector("features").alias("features"),
        F.col("label").cast("double").alias("label"),
        F.when(F.col("label") == 1, positive).otherwise(negative).cast("double").alias("weight"),
    )


def _balanced(frame: DataFrame) -> tuple[DataFrame, float]:
    """Class weights n / (2·n_c) and their sum (= n)."""
    counts = frame.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p")).first()
    n, p = counts["n"], counts["p"]
    return _weighted(frame, n / (2.0 * max(p, 1)), n / (2.0 * max(n - p, 1))), float(n)


def train_logistic(frame: DataFrame, config: LearningConfig = LearningConfig()) -> LogisticRegressionModel:
    """L2 logistic regression. Spark averages the loss, hence the penalty 1 / (C·Σw)."""
    weighted, total = _balanced(frame)
    return LogisticRegression(
        weightCol="weight", standardization=False, regParam=1.0 / (config.lr_c * total), maxIter=config.lr_iterations, tol=config.lr_tolerance
    ).fit(weighted)


def train_random_forest(frame: DataFrame, config: LearningConfig = LearningConfig()) -> RandomForestClassificationModel:
    weighted, _ = _balanced(frame)
    return RandomForestClassifier(
        weightCol="weight",
        numTrees=config.rf_trees,
        maxDepth=config.rf_depth,
        minInstancesPerNode=config.rf_min_leaf,
        featureSubsetStrategy="sqrt",
        seed=config.seed,
    ).fit(weighted)


def train_boosting(frame: DataFrame, config: LearningConfig = LearningConfig(), variant: str = "lgb") -> GBTClassificationModel:
    """Boosted trees: ``lgb`` balances the classes, ``xgb`` multiplies positives by a factor."""
    weighted = _balanced(frame)[0] if variant == "lgb" else _weighted(frame, config.positive_factor, 1.0)
    return GBTClassifier(
        weightCol="weight",
        maxIter=config.boost_rounds,
        stepSize=config.boost_rate,
        maxDepth=config.boost_depth,
        minInstancesPerNode=20 if variant == "lgb" else 3,
        subsamplingRate=config.row_share,
        featureSubsetStrategy=config.column_share,
        seed=config.seed,
    ).fit(weighted)


@dataclass
class NeighborModel:
    """The training rows themselves; scoring is a nearest-neighbour join, over an index where they are too many to broadcast."""

    rows: DataFrame
    k: int
    index: NeighborIndex | None = None
    options: dict = field(default_factory=dict)


def train_knn(frame: DataFrame, config: LearningConfig = LearningConfig(), broadcast_bytes: int = BROADCAST_BYTES) -> NeighborModel:
    rows = frame.select("id", "features", "label")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    fits = size["n"] * (8 * (size["d"] or 0) + 8) <= broadcast_bytes
    return NeighborModel(rows, config.knn_k, None if fits else index_rows(rows, config.knn_k))


def fit_member(name: str, frame: DataFrame, config: LearningConfig):
    trainers = {"lr": train_logistic, "rf": train_random_forest, "knn": train_knn}
    if name in trainers:
        return trainers[name](frame, config)
    return train_boosting(frame, config, name)


def add_probabilities(frame: DataFrame, models: dict) -> DataFrame:
    """Add one fraud probability column per named model to a frame with ``id`` and ``features``.

    Spark ML members extend the row, forests a batch of rows at a time; a neighbour member is joined by id.
    """
    columns = frame.columns
    native = {o: m for o, m in models.items() if not isinstance(m, NeighborModel)}
    if native:
        scored, found = frame.withColumn("_vec", array_to_vector("features")), []
        for output, model in native.items():
            if isinstance(model, RandomForestClassificationModel) and model.numClasses == 2:
                found.append(forest_probability(model, vector_to_array("_vec"), frame.sparkSession).alias(output))
                continue
            model = model.copy()
            model.setFeaturesCol("_vec").setProbabilityCol(f"_prob_{output}").setRawPredictionCol("").setPredictionCol("")
            scored = model.transform(scored)
            found.append(vector_to_array(f"_prob_{output}")[1].alias(output))
        frame = scored.select(*columns, *found)
    for output, model in models.items():
        if output not in native:
            votes = knn_probability(frame, model.rows, model.k, "id", "features", "label", model.index, **model.options)
            votes = votes.select(F.col("q_id").alias("_q"), F.col("probability").alias(output))
            frame = frame.join(votes, F.col("id") == F.col("_q"), "left").drop("_q")
    return frame


def add_probability(model, frame: DataFrame, output: str) -> DataFrame:
    return add_probabilities(frame, {output: model})


@dataclass
class Calibrated:
    """One (model, isotonic map) pair per fold; the calibrated score is their mean."""

    pairs: list

    def add(self, frame: DataFrame, output: str) -> DataFrame:
        columns = frame.columns
        frame = add_probabilities(frame, {f"_score{i}": model for i, (model, _) in enumerate(self.pairs)})
        for i, (_, isotonic) in enumerate(self.pairs):
            frame = isotonic.copy().setFeaturesCol(f"_score{i}").setPredictionCol(f"_cal{i}").transform(frame)
        total = " + ".join(f"_cal{i}" for i in range(len(self.pairs)))
        return frame.select(*columns, F.expr(f"({total}) / {len(self.pairs)}D AS `{output}`"))


def _folds(frame: DataFrame, folds: int) -> DataFrame:
    """Training rows with their fold."""
    # Stored because every fit reads them many times.
    return stored(stratified_folds(frame.select("id", "features", "label"), "id", folds), "folds", "id")


def calibrate(name: str, frame: DataFrame, config: LearningConfig = LearningConfig(), folded: DataFrame | None = None) -> Calibrated:
    """Per fold: fit on the others, map the held-out scores isotonically to labels.

    ``folded`` are the rows with their fold, if they are stored already.
    """
    folded = _folds(frame, config.calibration_folds) if folded is None else folded

    def one(i: int) -> tuple:
        model = fit_member(name, folded.where(F.col("fold") != i).drop("fold"), config)
        held_out = add_probability(model, folded.where(F.col("fold") == i), "_score")
        return model, fit_isotonic(held_out)

    return Calibrated(fit_together([partial(one, i) for i in range(config.calibration_folds)], frame.sparkSession, config.fit_threads))


def fold_scores(frame: DataFrame, members: tuple[str, ...], config: LearningConfig = LearningConfig()) -> DataFrame:
    """``model, fold, rows, hits, false_alarms, missed, f1``: each member fitted on the other folds and counted on its own."""
    folded = _folds(frame, config.validation_folds)

    def one(name: str, i: int) -> DataFrame:
        model = fit_member(name, folded.where(F.col("fold") != i).drop("fold"), config)
        scored = add_probability(model, folded.where(F.col("fold") == i), "probability")
        return scored.select(F.lit(name).alias("model"), "fold", "label", "probability")

    jobs = [partial(one, name, i) for name in members for i in range(config.validation_folds)]
    parts = reduce(DataFrame.unionByName, fit_together(jobs, frame.sparkSession, config.fit_threads))
    said, actual = F.col("probability") > 0.5, F.col("label") == 1
    counts = parts.groupBy("model", "fold").agg(
        F.count("*").alias("rows"), F.count_if(said & actual).alias("hits"), F.count_if(said & ~actual).alias("false_alarms"), F.count_if(~said & actual).alias("missed")
    )
    f1 = F.try_divide(2 * F.col("hits"), 2 * F.col("hits") + F.col("false_alarms") + F.col("missed"))
    return counts.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def cross_validate(frame: DataFrame, members: tuple[str, ...], config: LearningConfig = LearningConfig()) -> DataFrame:
    """``model, cv_f1``: mean F1 over stratified folds."""
    return fold_scores(frame, members, config).groupBy("model").agg(F.avg("f1").alias("cv_f1"))


@dataclass
class Ensemble:
    """Fitted members with their scaling, metrics and importances."""

    features: list[str]
    scale: list[tuple[float, float]]
    members: dict
    calibrated: dict[str, Calibrated]
    config: LearningConfig
    metrics: dict = field(default_factory=dict)
    importances: dict[str, float] = field(default_factory=dict)

    @property
    def weights(self) -> dict[str, float]:
        return weights_for(tuple(self.members))

    def vectors(self, df: DataFrame) -> DataFrame:
        """Add ``id`` (the row index) and standardised ``features``; absent features are 0."""
        have = set(df.columns)
        raw = [f"coalesce(CAST(`{c}` AS DOUBLE), 0D)" if c in have else "0D" for c in self.features]
        scaled = [f"({r} - {double(m)}) / {double(d)}" for r, (m, d) in zip(raw, self.scale)]
        return with_expressions(df, {"id": f"CAST({ROW_INDEX} AS BIGINT)", "features": f"array({', '.join(scaled)})"})

    def member_probabilities(self, frame: DataFrame, calibrated: bool = True) -> DataFrame:
        """Add ``p_<member>`` for every member."""
        plain = {n: m for n, m in self.members.items() if not (calibrated and n in self.calibrated)}
        # A given number, because small rows mean much work here: hundreds of trees each. By size they would go to one task.
        frame = frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
        frame = add_probabilities(frame, {f"p_{n}": m for n, m in plain.items()})
        for name in self.members:
            if name not in plain:
                frame = self.calibrated[name].add(frame, f"p_{name}")
        return frame

    def blend(self, frame: DataFrame, output: str) -> DataFrame:
        total = " + ".join(f"{double(w)} * p_{name}" for name, w in self.weights.items())
        return with_expressions(frame, {output: total})

    def predict(self, df: DataFrame, output: str = "ml_fraud_prob") -> DataFrame:
        """Add the ensemble probability to any frame with ``row_idx`` and the feature columns.

        Without a neighbour member everything stays in one row-wise plan after the rows are spread over tasks; with it
        the votes are joined by row index.
        """
        columns = df.columns
        scored = self.blend(self.member_probabilities(self.vectors(df)), output)
        return scored.select(*columns, output)

    def save(self, spark: SparkSession, path: str) -> None:
        """Store all members, calibrators and facts below ``path``."""
        for name, model in self.members.items():
            _save_model(model, f"{path}/members/{name}")
        for name, calibrated in self.calibrated.items():
            for i, (model, isotonic) in enumerate(calibrated.pairs):
                _save_model(model, f"{path}/calibrated/{name}/{i}/model")
                isotonic.write().overwrite().save(f"{path}/calibrated/{name}/{i}/isotonic")
        facts = {
            "features": self.features,
            "scale": self.scale,
            "members": list(self.members),
            "calibrated": {n: len(c.pairs) for n, c in self.calibrated.items()},
            "config": asdict(self.config),
            "metrics": self.metrics,
            "importances": self.importances,
        }
        spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").json(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        facts = json.loads(spark.read.schema("facts string").json(f"{path}/facts").first()["facts"])
        known = {f.name for f in fields(LearningConfig)}  # Stored models may have settings that are no more.
        config = LearningConfig(**{**{n: v for n, v in facts["config"].items() if n in known}, "members": tuple(facts["config"]["members"])})
        members = {n: _load_model(spark, n, f"{path}/members/{n}", config) for n in facts["members"]}
        calibrated = {
            n: Calibrated(
                [
                    (
                        _load_model(spark, n, f"{path}/calibrated/{n}/{i}/model", config),
                        IsotonicRegressionModel.load(f"{path}/calibrated/{n}/{i}/isotonic"),
                    )
                    for i in range(count)
                ]
            )
            for n, count in facts["calibrated"].items()
        }
        scale = [tuple(p) for p in facts["scale"]]
        return Ensemble(facts["features"], scale, members, calibrated, config, facts["metrics"], facts["importances"])


def _save_model(model, path: str) -> None:
    if isinstance(model, NeighborModel):
        model.rows.write.mode("overwrite").parquet(f"{path}/rows")
        if model.index is not None:
            model.index.save(f"{path}/index")
        facts = {"indexed": model.index is not None}
        model.rows.sparkSession.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").json(f"{path}/facts")
    else:
        model.write().overwrite().save(path)


def _load_model(spark: SparkSession, name: str, path: str, config: LearningConfig):
    if name == "knn":
        indexed = json.loads(spark.read.schema("facts string").json(f"{path}/facts").first()["facts"])["indexed"]
        return NeighborModel(spark.read.parquet(f"{path}/rows"), config.knn_k, load_index(spark, f"{path}/index") if indexed else None)
    kinds = {"lr": LogisticRegressionModel, "rf": RandomForestClassificationModel}
    return kinds.get(name, GBTClassificationModel).load(path)


def evaluate(scored: DataFrame, members: list[str]) -> dict:
    """Metrics of the blended ``probability`` and F1 of each ``p_<member>``, as plain values."""
    metrics = classification_metrics(scored).first().asDict()
    metrics["roc_auc"] = roc_auc(scored).first()[0]
    metrics["pr_auc"] = average_precision(scored).first()[0]
    individual = f1_scores(scored, [f"p_{m}" for m in members]).first().asDict()
    metrics["individual"] = {k.removeprefix("p_"): v for k, v in individual.items()}
    return metrics


def feature_importance(models: dict, features: list[str]) -> dict[str, float]:
    """Mean of the tree members' importances, each normalised to 1; uniform without trees."""
    trees = [m.featureImportances.toArray().tolist() for m in models.values() if hasattr(m, "featureImportances")]
    return mean_importance(trees, features)


def train_ensemble(
    df: DataFrame,
    label: str = "label",
    config: LearningConfig = LearningConfig(),
    features: list[str] | None = None,
    clean_links: bool = True,
    with_calibration: bool = True,
    with_validation: bool = False,
) -> Ensemble | None:
    """Fit the ensemble on a prepared, labelled frame with ``row_idx``; None when there is too little data.

    Split → standardise on training rows → oversample (and drop Tomek links) → fit →
    calibrate on the unbalanced training rows → evaluate on the held-out rows.
    """
    features = features or numeric_features(df)
    if not features:
        return None
    labelled = df.select(F.col(ROW_INDEX).cast("bigint").alias("id"), F.col(label).cast("int").alias("label"), *features)
    split = stored(stratified_split(align_features(labelled, features, ["id", "label"]), "id"), "training", "id")
    if not training_guard(split).first()["trainable"]:
        return None
    fitted = scaling(split.where(F.col("is_test") == 0), features).first()["scaling"]
    scale = [(p["mean"], p["std"]) for p in fitted]
    ensemble = Ensemble(features, scale, {}, {}, config)
    rows = ensemble.vectors(split.withColumn(ROW_INDEX, F.col("id"))).select("id", "label", "is_test", "features")
    train, test = rows.where("is_test = 0").drop("is_test"), rows.where("is_test = 1").drop("is_test")
    balanced = stored((smote_tomek if clean_links else smote)(train).select("id", "features", "label"), "balanced", "id")
    spark, names = df.sparkSession, config.members
    ensemble.members = dict(zip(names, fit_together([partial(fit_member, n, balanced, config) for n in names], spark, config.fit_threads)))
    if with_calibration:
        folded = _folds(train, config.calibration_folds)
        jobs = [partial(calibrate, n, train, config, folded) for n in names]
        ensemble.calibrated = dict(zip(names, fit_together(jobs, spark, config.fit_threads)))
    ensemble.importances = feature_importance(ensemble.members, features)
    scored = stored(ensemble.blend(ensemble.member_probabilities(test, calibrated=False), "probability").drop("features"), "test")
    ensemble.metrics = evaluate(scored, list(config.members))
    if with_validation:
        found = cross_validate(train, config.members, config).collect()  # one row per member
        ensemble.metrics["cv_scores"] = {f"{r['model']}_f1": r["cv_f1"] for r in found}
    return ensemble


def small_config(**changes) -> LearningConfig:
    """A light variant for small data and tests."""
    return replace(LearningConfig(rf_trees=20, rf_depth=6, boost_rounds=10, boost_depth=4, lr_iterations=100), **changes)
