"""Headline queries, timed: prints one JSON line.

Every query runs to the end (all rows and columns are produced), once to warm up and then
``BENCH_RUNS`` times; the best time counts, the median and the worst are given too.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from reqsieve.plans.registry import QUERIES
from reqsieve.session import local_session

HEADLINE = [
    "analyze", "verdict", "blocked_only", "match_patterns", "match_directives", "diff_runs", "diff_details",
    "group_by_rule", "group_by_ip", "group_examples", "list_requests", "extract_args", "parse_headers",
    "request_key", "scan_capture", "scan_ndjson", "latest_run", "previous_run", "baseline_state", "write_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "bench", **{"spark.python.sql.dataFrameDebugging.enabled": "false"})
    seconds, median, worst = {}, {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
        median[name], worst[name] = round(statistics.median(times[1:]), 3), round(max(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "median": median, "worst": worst, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
