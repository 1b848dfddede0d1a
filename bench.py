"""Seconds per headline query. Prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Every query is run
twice in full into a sink that discards its rows; ``queries`` holds the second, warm run and ``cold``
the first.
"""

from __future__ import annotations

import json
import os
import time

from quillwork import plans
from quillwork.session import local_session

HEADLINE = [
    "row_metrics", "solve_rows", "kerning", "sauvola", "page_skew", "components", "lookalikes", "device_limit",
    "progress_eta", "search_match", "text_width", "text_coverage", "trace_loops", "smooth_contour", "health_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, cpus)
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().write.format("noop").mode("overwrite").save()
    cold, times = {}, {}
    for key in HEADLINE:
        for seen in (cold, times):
            start = time.perf_counter()
            plans.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seen[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, warm total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
