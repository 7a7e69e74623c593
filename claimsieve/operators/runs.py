"""Run history and the aggregates of the dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import exact_quantiles
from ..session import stored

KEEP_RUNS = 50
POSITIVE = ("Fraud", "Y")
#: Size of a quantile sketch; its ranks are off by less than 0.5 percent of the rows in 99 of 100 cases.
SKETCH_SIZE = 800
#: Columns that get a sketch.
SKETCHED = ["total_claim_amount", "final_risk_score"]
#: Counts of one run that add up over runs.
ROLLUP = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("item", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("sketch", T.BinaryType()),
])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def run_records(results: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    """One record per run: band counts, mean score, predicted frauds."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("claims_count"),
        F.count_if(F.col("risk_level") == "High").alias("high_risk_count"),
        F.count_if(F.col("risk_level") == "Medium").alias("medium_risk_count"),
        F.count_if(F.col("risk_level") == "Low").alias("low_risk_count"),
        F.avg("final_risk_score").alias("avg_risk_score"),
        F.count_if(F.col("fraud_prediction").isin(*POSITIVE)).alias("fraud_predictions"),
    )


def recent_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    """Newest ``k`` runs with the fraud rate of each; a top-k, not a global window."""
    return runs.withColumn(
        "fraud_rate", _ratio(F.col("high_risk_count"), F.col("claims_count")) * 100
    ).orderBy(F.desc("timestamp"), F.desc("run_id")).limit(k)


def retain_last_runs(runs: DataFrame, keep: int = KEEP_RUNS) -> DataFrame:
    return runs.orderBy(F.desc("timestamp"), F.desc("run_id")).limit(keep)


def run_time_series(runs: DataFrame) -> DataFrame:
    return runs.select(
        "timestamp", "claims_count", "high_risk_count", "avg_risk_score", "runtime", "fraud_predictions"
    ).orderBy("timestamp")


def session_statistics(runs: DataFrame, session_start: Column | None = None, now: Column | None = None) -> DataFrame:
    """One row over all runs; zeros when there are none."""
    start = F.min("timestamp") if session_start is None else session_start
    now = F.current_timestamp() if now is None else now
    totals = runs.agg(
        F.count("*").alias("total_analyses"),
        F.coalesce(F.sum("claims_count"), F.lit(0)).alias("total_claims"),
        F.coalesce(F.sum("runtime"), F.lit(0.0)).alias("total_runtime"),
        F.coalesce(F.sum("high_risk_count"), F.lit(0)).alias("_high"),
        F.coalesce(F.sum("fraud_predictions"), F.lit(0)).alias("_fraud"),
        F.coalesce((F.unix_micros(now) - F.unix_micros(start)) / 3.6e9, F.lit(0.0)).alias("session_duration"),
    )
    return totals.select(
        "total_analyses",
        "total_claims",
        _ratio(F.col("total_claims"), F.col("total_analyses")).alias("avg_claims_per_analysis"),
        "total_runtime",
        _ratio(F.col("total_runtime"), F.col("total_analyses")).alias("avg_runtime"),
        (_ratio(F.col("_high"), F.col("total_claims")) * 100).alias("high_risk_rate"),
        (_ratio(F.col("_fraud"), F.col("total_claims")) * 100).alias("fraud_detection_rate"),
        "session_duration",
    )


def total_claims(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.sum("claims_count"), F.lit(0)).alias("total_claims"))


def high_risk_pct(runs: DataFrame) -> DataFrame:
    return runs.agg((_ratio(F.sum("high_risk_count"), F.sum("claims_count")) * 100).alias("high_risk_pct"))


def avg_runtime(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.avg("runtime"), F.lit(0.0)).alias("avg_runtime"))


def kpi_status(high_pct: Column, runtime: Column, accuracy: Column) -> list[Column]:
    """Status words of the three indicators."""
    return [
        F.when(high_pct > 15, "High Alert").when(high_pct < 5, "Normal").otherwise("Monitor").alias("risk_status"),
        F.when(runtime < 2, "Fast").when(runtime < 5, "Normal").otherwise("Slow").alias("speed_status"),
        F.when(accuracy > 0.85, "Excellent").when(accuracy > 0.7, "Good").otherwise("Training").alias("accuracy_status"),
    ]


def dashboard_kpis(results: DataFrame) -> DataFrame:
    """One row: claims, flagged (= High), mean final score, high risk count, fraud rate."""
    high = F.count_if(F.col("risk_level") == "High")
    return results.agg(
        F.count("*").alias("total_analyzed"),
        high.alias("flagged_count"),
        F.coalesce(F.avg("final_risk_score"), F.lit(0.0)).alias("avg_risk_score"),
        high.alias("high_risk_count"),
        (_ratio(high, F.count("*")) * 100).alias("fraud_rate"),
    )


def risk_distribution(results: DataFrame, level: str = "risk_level") -> DataFrame:
    return results.groupBy(level).agg(F.count("*").alias("n"))


def rule_counts(results: DataFrame) -> DataFrame:
    """Firings per rule, from the indicator array or the joined text."""
    if "top_indicators" in results.columns:
        rules = F.col("top_indicators")
    else:
        rules = F.split("triggered_rules", ",")
    # The outer form: a plain explode would add a filter on the array's size and have
    # the array computed once more for it.
    exploded = results.select(F.explode_outer(rules).alias("rule")).select(F.trim("rule").alias("rule"))
    return exploded.where(F.col("rule") != "").groupBy("rule").agg(F.count("*").alias("n"))


def top_rules(results: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent rules; ties by name."""
    return rule_counts(results).orderBy(F.desc("n"), "rule").limit(k)


def daily_claim_counts(results: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    return results.groupBy(F.date_format(timestamp, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def performance_metrics(runs: DataFrame, results: DataFrame) -> DataFrame:
    """One row: run times, batch sizes and the spread of all scores (population deviations)."""
    scores = results.agg(
        F.struct(
            F.coalesce(F.avg("final_risk_score"), F.lit(0.0)).alias("mean"),
            F.coalesce(F.stddev_pop("final_risk_score"), F.lit(0.0)).alias("std"),
        ).alias("s")
    )
    return (
        runs.agg(
            F.avg("runtime").alias("avg_runtime"),
            F.min("runtime").alias("min_runtime"),
            F.max("runtime").alias("max_runtime"),
            F.stddev_pop("runtime").alias("std_runtime"),
            F.avg("claims_count").alias("avg_claims_per_batch"),
            F.sum("claims_count").alias("total_unique_claims"),
        )
        .withColumn("_s", scores.scalar())
        .withColumns({"avg_risk_score_overall": F.col("_s.mean"), "risk_score_std": F.col("_s.std")})
        .drop("_s")
    )


def fraud_patterns(results: DataFrame) -> DataFrame:
    """Long table ``pattern, item, value``: top-10 rules, band counts, top-5 hours, amount percentiles.

    The four columns it needs are stored once, so what makes the results runs once. All counts come
    from one aggregate over (pattern, item).
    """
    rules = F.col("top_indicators") if "top_indicators" in results.columns else F.split("triggered_rules", ",")
    narrow = stored(
        results.select(rules.alias("rules"), "risk_level", "incident_hour_of_the_day", F.col("total_claim_amount").cast("double").alias("total_claim_amount")), "patterns"
    )
    items = (
        "concat(transform(coalesce(rules, array()), r -> named_struct('pattern', 'most_common_rules', 'item', trim(r))), "
        "array(named_struct('pattern', 'risk_distribution', 'item', risk_level), "
        "named_struct('pattern', 'peak_fraud_hours', 'item', CAST(CAST(incident_hour_of_the_day AS INT) AS STRING))))"
    )
    counts = narrow.selectExpr(f"inline({items})").where("NOT (pattern = 'most_common_rules' AND item = '')").groupBy("pattern", "item").agg(F.count("*").alias("n"))
    # Rules and bands are few, hours are 24: a small table from here on.
    number = F.when(F.col("pattern") == "peak_fraud_hours", F.col("item").cast("int"))
    order = Window.partitionBy("pattern").orderBy(F.desc("n"), number, "item")
    most = F.when(F.col("pattern") == "most_common_rules", 10).when(F.col("pattern") == "peak_fraud_hours", 5)
    kept = counts.withColumn("_place", F.row_number().over(order)).where(most.isNull() | (F.col("_place") <= most))
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    amounts = exact_quantiles(narrow, ["total_claim_amount"], shares)
    quartiles = F.array(*[F.struct(F.lit(q).alias("item"), F.col(q).alias("value")) for q in shares])
    return kept.select("pattern", "item", F.col("n").cast("double").alias("value")).union(amounts.select(F.lit("amount_quartiles"), F.inline(quartiles)))


def export_session_json(runs: DataFrame, now: Column | None = None) -> DataFrame:
    """One row, one JSON text: statistics and the retained runs, oldest first.

    The list holds at most :data:`KEEP_RUNS` records.
    """
    now = F.current_timestamp() if now is None else now
    kept = retain_last_runs(runs)
    record = F.struct(
        "timestamp", "claims_count", "high_risk_count", "medium_risk_count", "low_risk_count",
        "avg_risk_score", "fraud_predictions", "runtime",
    )
    stats = session_statistics(kept, now=now)
    history = kept.agg(F.array_sort(F.collect_list(record)).alias("h")).scalar()
    return stats.select(
        F.to_json(
            F.struct(
                now.alias("export_timestamp"),
                F.struct(*stats.columns).alias("session_statistics"),
                history.alias("analysis_history"),
            )
        ).alias("session_json")
    )


def rollup(results: DataFrame) -> DataFrame:
    """What the dashboards need of each run, in a form that adds up over runs: (run_id, kind, item, n, total, sketch).

    Kinds are "all" (rows, and the sum of the scores), "band", "day", "rule" (rows per item) and "sketch" (a mergeable quantile
    sketch per column). Days and rules are left out where the results have none.
    """
    score = F.col("final_risk_score").cast("double")
    item = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("item"))
    items = [item("all", F.lit("")), item("band", F.col("risk_level"))]
    if "timestamp" in results.columns:
        items.append(item("day", F.date_format("timestamp", "yyyy-MM-dd")))
    every = F.array(*items)
    rules = F.col("top_indicators") if "top_indicators" in results.columns else F.split("triggered_rules", ",") if "triggered_rules" in results.columns else None
    if rules is not None:
        named = F.filter(F.transform(F.coalesce(rules, F.array()), F.trim), lambda r: r != "")
        every = F.concat(every, F.transform(named, lambda r: item("rule", r)))
    rows = results.select(F.col("run_id").cast("string").alias("run_id"), score.alias("score"), F.inline(every))
    counts = rows.groupBy("run_id", "kind", "item").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "all", F.col("score"))).alias("total"))
    counts = counts.withColumn("sketch", F.lit(None).cast("binary"))
    columns = [c for c in SKETCHED if c in results.columns]
    if not columns:
        return counts
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    sketched = results.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(*[F.kll_sketch_agg_double(value[c], F.lit(SKETCH_SIZE)).alias(c) for c in columns])
    long = sketched.select("run_id", F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("sketch")) for c in columns])))
    return counts.unionByName(long.select("run_id", F.lit("sketch").alias("kind"), "item", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("total"), "sketch"))


def rollup_counts(rolled: DataFrame, kind: str, name: str) -> DataFrame:
    """(name, n): rows per item of one kind over all runs of a rollup."""
    return rolled.where(F.col("kind") == kind).groupBy(F.col("item").alias(name)).agg(F.sum("n").alias("n"))


def rollup_kpis(rolled: DataFrame) -> DataFrame:
    """:func:`dashboard_kpis` from rollups."""
    every, high = F.col("kind") == "all", (F.col("kind") == "band") & (F.col("item") == "High")
    rows, flagged = F.coalesce(F.sum(F.when(every, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(high, F.col("n"))), F.lit(0))
    return rolled.agg(
        rows.alias("total_analyzed"),
        flagged.alias("flagged_count"),
        F.coalesce(F.try_divide(F.sum("total"), rows), F.lit(0.0)).alias("avg_risk_score"),
        flagged.alias("high_risk_count"),
        (_ratio(flagged, rows) * 100).alias("fraud_rate"),
    )


def rollup_top_rules(rolled: DataFrame, k: int = 10) -> DataFrame:
    """:func:`top_rules` from rollups."""
    return rollup_counts(rolled, "rule", "rule").orderBy(F.desc("n"), "rule").limit(k)


def rollup_quantiles(rolled: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(col, one column per share): quantiles over all runs from their merged sketches; no claim is read."""
    merged = rolled.where("kind = 'sketch' AND sketch IS NOT NULL").groupBy(F.col("item").alias("col")).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    full = F.kll_sketch_get_n_double("sketch") > 0
    return merged.select("col", *[F.when(full, F.kll_sketch_get_quantile_double("sketch", F.lit(share))).alias(name) for name, share in shares.items()])
