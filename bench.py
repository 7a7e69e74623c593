"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from claimsieve.catalog import QUERIES  # noqa: E402
from claimsieve.session import build_session  # noqa: E402

HEADLINE = [
    "prepare_claims",
    "dedupe_claim_ids",
    "score_claims",
    "add_explanations",
    "summary_insights",
    "dictionary_features",
    "outlier_pct",
    "fraud_patterns",
    "run_records",
    "join_labels",
    "export_join",
    "shapiro_wilk",
    "ks_normal",
    "qq_points",
    "stratified_split",
    "knn_join",
    "smote_tomek",
    "train_logistic",
    "train_random_forest",
    "calibrate_lr",
    "roc_auc",
    "feature_contributions",
    "lineitem_quality",
    "ensemble_predict",
    "score_claims_with_model",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small run first, so JVM start-up is not charged to the first query.
    QUERIES["prepare_claims"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        # The noop sink computes every column of every row.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
