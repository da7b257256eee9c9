"""Headline queries at one scale; prints a single JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from renewlens.plans import catalog
from renewlens.session import build_session

HEADLINE = (
    "narrow_logs",
    "aggregate_asof",
    "build_labels",
    "build_log_features",
    "build_features",
    "split_four_group",
    "target_encode_oof",
    "segment_report",
    "roc_auc",
    "reliability_curve",
    "campaign_curve",
    "sensitivity_grid",
    "psi_table",
    "audit_frame",
    "score_table",
    "fit_scorer",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "renewlens-bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the session's workers and loads the classes every query needs.
    catalog.QUERIES["aggregate_asof"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
