"""Benchmark the headline queries and print ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPS (timed runs per query after one warm-up, default 3), BENCH_QUERIES
(comma list to restrict). Each run executes the whole plan into Spark's
``noop`` sink (nothing is collected); the per-query value is the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "select_rows_expr", "derived_time_diff", "group_agg_multi_agg", "percentile_grouped", "mode",
    "group_top_n", "sort_rows_position", "top_n", "rolling_average", "smooth_centered", "concurrency",
    "graph_nodes", "copod_leaderboard", "eval_metrics", "pr_curve", "inne_scores", "lof_scores",
    "iforest_scores", "benchmark_leaderboard", "pseudo_evaluation", "retrieval_topk", "fuzzy_match",
    "keyword_tags", "action_parse",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from rowscope.plans.catalog import load
    from rowscope.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    QUERIES = load()[0]
    names = [q for q in (only or HEADLINE) if q in QUERIES]
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        fn = QUERIES[name]
        runs = []
        try:
            for i in range(reps + 1):
                t0 = time.perf_counter()
                df = fn(spark, sf_dir)
                df.write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                if i > 0:
                    runs.append(dt)
            times[name] = round(statistics.median(runs), 3)
            rows[name] = fn(spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            times[name] = None
            print(f"# {name} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    total = round(sum(v for v in times.values() if v is not None), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_median_sec", "value": total, "unit": "sec",
        "queries": times, "rows_out": rows, "sf": sf, "cpus": cpus, "reps": reps,
        "shuffle_partitions": max(8, cpus * 2), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
