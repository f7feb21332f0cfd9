"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Each query runs to the end into a no-op sink; one small query
first starts the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from routewright.plans import registry
from routewright.session import local_session

HEADLINE = [
    "bm25_search",
    "pred_schemas",
    "bm25_autotune",
    "few_shot_examples",
    "segment_entropy_weight",
    "segment_cover_greedy",
    "dense_search",
    "catalog_build",
    "sql_mentions",
    "fk_clique_members",
    "random_walks",
    "beam_aggregate",
    "context_random5",
    "parse_segments",
    "micro_recall",
    "precision_recall_curve",
    "paired_t_test",
    "pending_requests",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = registry.queries()
    queries["melt_sweep"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
