"""Labels, splits, scaling and class balancing of training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import exact_quantiles
from ..plans.strata import assign_blocks
from ..session import stored
from .neighbors import NeighborIndex, knn_join

MIN_ROWS, MIN_POSITIVES = 50, 5
TEST_SHARE = 0.2
SMOTE_NEIGHBORS = 5
#: Synthetic rows made from one row before the work is spread again.
SMOTE_CHUNK = 10_000


def pseudo_labels(df: DataFrame, score: str = "risk_score", rules: str = "triggered_rules") -> DataFrame:
    """Add ``label``: score above 70 with at least three rules.

    When that finds nobody, scores above the 0.9 quantile; only then is the quantile computed.
    """
    commas = F.length(rules) - F.length(F.replace(F.col(rules), F.lit(","), F.lit("")))
    strict = F.coalesce((F.col(score) > 70) & (commas >= 2), F.lit(False))
    if df.where(strict).limit(1).count():
        return df.withColumn("label", strict.cast("int"))
    cut = exact_quantiles(df, [score], {"q90": 0.9}).select("q90").scalar()
    return df.withColumn("label", F.coalesce(F.col(score) > cut, F.lit(False)).cast("int"))


def training_guard(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: ``n_rows, n_positive, trainable``."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(label) == 1).alias("n_positive")
    ).withColumn("trainable", (F.col("n_rows") >= MIN_ROWS) & (F.col("n_positive") >= MIN_POSITIVES))


def stratified_split(df: DataFrame, key: str, label: str = "label", test_share: float = TEST_SHARE) -> DataFrame:
    """Add ``is_test``: the first share of each label in hash order."""
    return assign_blocks(df, label, key, [test_share], "_block").withColumn(
        "is_test", (F.col("_block") == 0).cast("int")
    ).drop("_block")


def stratified_folds(df: DataFrame, key: str, folds: int, label: str = "label") -> DataFrame:
    """Add ``fold`` 0..folds−1: equal consecutive shares of each label in hash order."""
    return assign_blocks(df, label, key, [i / folds for i in range(1, folds)], "fold")


def scaling(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: array of (mean, population deviation) per column; a constant column divides by 1."""
    pairs = []
    for c in columns:
        deviation = F.stddev_pop(c)
        pairs.append(F.struct(F.avg(c).alias("mean"), F.when(deviation > 0, deviation).otherwise(1.0).alias("std")))
    return train.agg(F.array(*pairs).alias("scaling"))


def scale_with(df: DataFrame, columns: list[str], fitted: Column) -> DataFrame:
    """Standardise ``columns`` with a fitted array, given as a literal or a scalar subquery."""
    scaled = df.withColumn("_fit", fitted)
    return scaled.withColumns(
        {c: (F.col(c) - F.col("_fit")[i]["mean"]) / F.col("_fit")[i]["std"] for i, c in enumerate(columns)}
    ).drop("_fit")


def standardize(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """z-scores with the moments of the training rows (population deviation)."""
    return scale_with(df, columns, scaling(df if train is None else train, columns).scalar())


def _hash_number(purpose: str) -> Column:
    text = F.concat_ws(":", F.col("id").cast("string"), F.col("_copy").cast("string"), F.lit(purpose))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def smote(
    df: DataFrame,
    id_column: str = "id",
    vector: str = "features",
    label: str = "label",
    k: int = SMOTE_NEIGHBORS,
    **options,
) -> DataFrame:
    """``id, features, label, synthetic``: the rows plus minority rows interpolated up to parity.

    Each minority row gets its even share of new rows, the remainder goes to the
    first in hash order. Neighbour and position on the segment follow from a hash of
    (id, copy), so the result does not depend on partitioning. New ids are negative.
    """
    base = df.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("features"), F.col(label).cast("int").alias("label")
    )
    sizes = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.count("*").alias("n")).collect()}
    zeros, ones = sizes.get(0, 0), sizes.get(1, 0)
    original = base.withColumn("synthetic", F.lit(0))
    minority_label, minority, missing = (1, ones, zeros - ones) if ones <= zeros else (0, zeros, ones - zeros)
    if missing == 0 or minority < 2:
        return original
    small = base.where(F.col("label") == minority_label)
    neighbors = min(k, minority - 1)
    # k neighbour ids per row, then their vectors: one row per (row, neighbour).
    near = knn_join(small, small, neighbors, "id", "features", exclude_self=True, **options)
    near = near.join(small.select(F.col("id").alias("t_id"), F.col("features").alias("t_vec")), "t_id")
    lists = near.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "t_vec"))).alias("near"))  # k entries
    share, rest = divmod(missing, minority)
    quota = assign_blocks(small, "label", "id", [rest / minority], "_block") if rest else small.withColumn("_block", F.lit(1))
    quota = quota.withColumn("_copies", F.lit(share) + F.when(F.col("_block") == 0, 1).otherwise(0))
    made = quota.join(lists, F.col("id") == F.col("q_id")).where(F.col("_copies") > 0)
    made = made.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(SMOTE_CHUNK))))
    if share > SMOTE_CHUNK:
        made = made.repartition("id", "_from")
    last = F.least(F.col("_from") + SMOTE_CHUNK, F.col("_copies")) - 1
    made = made.withColumn("_copy", F.explode(F.sequence(F.col("_from"), last)))
    # Eight hex digits of md5(id:copy:purpose), so that any SQL can follow the choice.
    pick = (_hash_number("neighbour") % F.size("near")).cast("int")
    u = _hash_number("position") / F.lit(float(1 << 32))
    mixed = made.withColumns({"_near": F.col("near")[pick]["t_vec"], "_u": u})
    synthetic = mixed.select(
        (-(F.col("id") * F.lit(share + 1) + F.col("_copy")) - 1).alias("id"),
        F.zip_with("features", "_near", lambda a, b: a + F.col("_u") * (b - a)).alias("features"),
        "label",
        F.lit(1).alias("synthetic"),
    )
    return original.unionByName(synthetic)


def tomek_links(
    df: DataFrame, id_column: str = "id", vector: str = "features", label: str = "label", index: NeighborIndex | None = None, **options
) -> DataFrame:
    """``a_id, b_id`` (a < b): mutual nearest neighbours of different labels. ``index`` may be one over ``df``."""
    near = knn_join(df, df if index is None else index, 1, id_column, vector, exclude_self=True, **options).select("q_id", "t_id")
    labels = df.select(F.col(id_column).cast("bigint").alias("_id"), F.col(label).alias("_label"))
    pairs = near.select(F.least("q_id", "t_id").alias("a_id"), F.greatest("q_id", "t_id").alias("b_id"))
    mutual = pairs.groupBy("a_id", "b_id").agg(F.count("*").alias("_n")).where(F.col("_n") == 2)
    with_a = mutual.join(labels.withColumnsRenamed({"_id": "a_id", "_label": "_la"}), "a_id")
    with_b = with_a.join(labels.withColumnsRenamed({"_id": "b_id", "_label": "_lb"}), "b_id")
    return with_b.where(F.col("_la") != F.col("_lb")).select("a_id", "b_id")


def remove_tomek_links(df: DataFrame, id_column: str = "id", vector: str = "features", label: str = "label", **options) -> DataFrame:
    """The rows that are no end of a Tomek link."""
    links = tomek_links(df, id_column, vector, label, **options)
    ends = links.select(F.explode(F.array("a_id", "b_id")).alias("_end"))
    return df.join(ends, F.col(id_column).cast("bigint") == F.col("_end"), "left_anti")


def smote_tomek(df: DataFrame, id_column: str = "id", vector: str = "features", label: str = "label", **options) -> DataFrame:
    """Oversample to parity, then remove both ends of every Tomek link."""
    # Read five times for the links.
    balanced = stored(smote(df, id_column, vector, label, **options), "balanced", "id")
    return remove_tomek_links(balanced, "id", "features", "label", **options)
