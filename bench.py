"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from stratafold.plans.registry import PLANS
from stratafold.session import build_session

HEADLINE = [
    "model_ranking", "roc_auc_by_model", "threshold_metrics", "class_report", "topk_capture", "gain_on_grid", "mean_curve",
    "rank_normalize", "rank_ensemble_weights", "metric_summary_long", "wilcoxon_exact", "friedman", "bootstrap_ci",
    "feature_matrix", "zone_flags", "zone_distance", "geo_strata", "balanced_draw", "pseudo_absences", "positive_sample",
    "distribution_summary", "ecdf", "pairwise_jaccard", "grouped_holdout", "split_manifest", "stratified_split",
    "standardize_train_only", "percentile_clip", "knn_feature_mean", "ego_graph", "raster_summary", "ensemble_mean_std",
    "sha256_manifest", "content_rule_scan", "component_merge_check", "best_checkpoint", "rf_scores", "prior_mlp_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session(
            "bench", f"local[{cpus}]",
            **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
        spark.sparkContext.setLogLevel("ERROR")
        spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
        seconds = {}
        for name in wanted:
            start = time.perf_counter()
            PLANS[name][0](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
