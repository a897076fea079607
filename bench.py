"""Times every registered query and prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores),
BENCH_QUERIES (comma-separated names, default all).
"""

from __future__ import annotations

import json
import os
import sys
import time


def main() -> None:
    from fleetspark.plans.registry import QUERIES
    from fleetspark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "fleetspark-bench")
    QUERIES["topology_counts"](spark, sf_dir).count()  # starts the workers and loads the classes

    spent: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {spent[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(spent.values()), 3),
        "unit": "sec",
        "queries": spent,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
