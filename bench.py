"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assayer.catalog import QUERIES  # noqa: E402
from assayer.session import build_session  # noqa: E402

HEADLINE = (
    "technique_metrics", "metrics_by_generator", "auc_line_items", "generator_metrics_line_items",
    "roc_curve", "delong_comparison", "bootstrap_interval", "all_wrong_by_generator",
    "pairwise_disagreement", "normalised_scores", "component_metrics", "stratified_split",
    "fusion_calibration_split", "duplicate_members", "content_leakage", "integrity_report",
    "divergences_line_items", "quantised_dct", "benford_feature_vectors", "cooccurrence_horizontal",
    "perturbed_signals", "fusion_scores", "latency_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in names:
        # The first run compiles; the second is timed.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    extra = {"metric_ms_per_sample": round(1000 * times["technique_metrics"] / n_events, 5)} if "technique_metrics" in times else {}
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": int(cpus), "timing": "second run", **extra}))


if __name__ == "__main__":
    main()
