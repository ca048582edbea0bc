"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS:   local threads (default 8)
BENCH_RUNS:   timed runs per query after one warm-up (default 3)
BENCH_QUERIES: comma list of names, or ``all``
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagegrain.plans import catalog  # noqa: E402

HEADLINE = [
    "x14_page_quality",
    "a1_page_density",
    "a4_page_coverage",
    "a5_region_coverage",
    "a7_box_black_pixels",
    "a12_skew_angle",
    "j3_region_children",
    "w2_reading_order",
    "w3_neighbour_context",
    "w4_pair_pages",
    "x1_page_text",
    "x1_unit_text",
    "p1_filter_boxes",
    "f14_compare_texts",
    "f24_engine_agreement",
    "f16_matches_native",
    "m3_delete_boxes",
    "m10_plan_metric_jobs",
    "a18_queue_status",
    "a14_entity_catalogue",
    "a19_person_timeline",
    "j17_place_links",
    "x2_search_documents",
    "x11_match_authority",
    "r3_job_throughput_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagegrain-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        warm = once(name)
        times[name] = round(statistics.median([once(name) for _ in range(runs)]) if runs else warm, 3)
        if wanted:
            print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
