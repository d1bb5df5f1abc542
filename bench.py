"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` a subset.
Every query is computed completely and its rows are thrown away (noop sink).  One small query warms
the session up first; each query then runs ``BENCH_RUNS`` times (2) and its best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "v_orders v_loyalty_metrics v_reviews v_semantic_orders v_semantic_loyalty p_fact_daily p_fact_daily_history "
    "p_kpi_brand p_kpi_brand_history p_dq_report p_anomalies p_anomalies_as_written p_daily_run "
    "win_trailing_mean_sd win_trailing_median agg_order_stats_banded jn_trailing_range jn_trailing_range_exploded "
    "lineage_khop lineage_khop_deep column_dictionary glossary_columns corpus_inventory"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE

    from marketday.registry import queries
    from marketday.session import local_session

    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    todo = queries()
    todo["agg_sum_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            todo[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        print(f"{name:32s} {' '.join(f'{t:7.2f}' for t in times)}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": spark.sparkContext.defaultParallelism,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
