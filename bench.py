"""Times the headline queries: one warm-up, then the median of BENCH_RUNS runs each. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from workload.check import session
from workload.queries import QUERIES

HEADLINE = (
    "alias_mapping", "normalize_contacts", "dedup_leads", "offline_score", "page_contacts", "text_contacts", "lead_page_contacts",
    "place_match_lev", "place_match_ratio", "field_resolution", "lead_score", "run_summary", "analytics_kpi", "score_histogram",
    "missing_fields", "lead_upsert", "batch_progress", "recent_runs_kpi", "incremental_leads",
)


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "2")))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in HEADLINE:
        run(spark, sf_dir, name)
        seconds[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
