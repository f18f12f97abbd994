"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

from alertloom.plans import catalog
from alertloom.session import local_session

HEADLINE = ("incidents_per_host", "incident_rollup", "sessionize", "intake_outcomes", "window_density", "largest_storm", "root_outage_groups",
            "failure_streaks", "missing_in_listing", "state_counts", "host_history", "fingerprint_stats", "run_metrics", "explode_answer",
            "validate_answers", "similar_cases", "retention_report", "estimate_tokens", "extract_terms", "redact", "neutralise",
            "scan_document_secrets", "split_sections", "classify_commands", "normalize_problems")


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{path}/events.parquet").count()  # start the workers
    seconds = {}
    for name in names:
        began = time.time()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    scale = re.search(r"sf([0-9.]+)", path)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
