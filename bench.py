"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanloom import session  # noqa: E402
from spanloom.plans import catalog  # noqa: E402

HEADLINE = [
    "trace_rollup", "trace_list_all", "trace_list_page", "trace_pages_all", "observation_cost", "trace_fold",
    "observation_dedupe", "trace_scores", "span_tree", "span_tree_observations", "ingest_events", "spend_by_attribute", "key_attribution",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session.local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    run(catalog.QUERIES["trace_rollup"](spark, sf_dir))
    for name in names:
        best = None
        for _ in range(2):
            t = time.perf_counter()
            run(catalog.QUERIES[name](spark, sf_dir))
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1],
    }))


if __name__ == "__main__":
    main()
