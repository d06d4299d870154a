"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the
local threads, ``BENCH_QUERIES`` a comma-separated choice (``all`` for every query).
Each query runs once to the end, all of its rows going to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import all_queries  # noqa: E402
from fieldstats.session import get_session  # noqa: E402

HEADLINE = [
    "mean_sem",
    "mean_sem_wide",
    "impute_mean",
    "to_long",
    "contingency_share",
    "box_stats",
    "box_stats_many",
    "box_outliers",
    "group_histogram",
    "describe_numeric",
    "mid_rank",
    "corr_pairs",
    "corr_pairs_spearman",
    "pair_regression",
    "kruskal_wallis",
    "dunn_test",
    "flow_dissolved",
    "flow_flux_by_river",
    "flow_flux_by_index",
    "flow_flux_by_landuse",
    "flow_emission_share",
    "flow_correlation",
    "flow_dissolved_by_river",
    "flow_dissolved_by_index_tests",
    "flow_dissolved_by_landuse_tests",
    "flow_oxygen_by_index",
    "feature_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    queries = all_queries()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = get_session(
        "fieldstats-bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's machinery before the clock does.
    queries["mean_sem"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total query time",
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
