"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is built and its whole result computed (no-op sink), one cold run each. The
models of the suite are timed one by one, and ``row_trees_per_sec`` relates their time to
training rows times trees (linear models: rows), so that they can be set against
published times for other row and tree counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = """scan_claims table_shape quantile_trim median_impute standard_scale interactions kfold_contiguous
segment_hierarchical segment_composite segmentation_search pairwise_search linear_regression lasso per_segment_models
voting_weighted stacking meta_features_wide segment_metrics weighted_metrics contributions sensitivity_screen
diverse_top_features similar_cases knn_regression score_stream random_forest gradient_boosting xgboost_like""".split()
TREES, FOREST_DEPTH, FOLDS = 100, 10, 5


def main() -> None:
    from claimwright.plans.catalog import QUERIES as registered
    from claimwright.plans.tree_models import model_frame, timed_suite
    from claimwright.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus) if cpus.isdigit() else 8,
        {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in QUERIES:
        start = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    frame = model_frame(spark, sf_dir)
    rows = frame.where("split = 'train'").count()
    work = {
        "Random Forest": TREES, "Gradient Boosting": TREES, "XGBoost": TREES, "Tuned XGBoost": 2 * TREES,
        "Voting Ensemble": 3 * TREES, "Stacking Ensemble": 3 * TREES * FOLDS,
    }
    models = {}
    for result in timed_suite(frame, None, TREES, FOREST_DEPTH, FOLDS):
        name = result["model"]
        models[name] = {
            "seconds": round(result["seconds"], 3),
            "r2": round(result["r2"], 4),
            "row_trees_per_sec": round(rows * work.get(name, 1) / result["seconds"]),
        }
        print(name, models[name], file=sys.stderr, flush=True)
    total = sum(seconds.values()) + sum(m["seconds"] for m in models.values())
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries and model suite",
                "value": round(total, 3),
                "unit": "sec",
                "queries": {**seconds, **{f"model: {n}": m["seconds"] for n, m in models.items()}},
                "models": models,
                "train_rows": rows,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
