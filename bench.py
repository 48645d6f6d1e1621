"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local
threads (default 8); BENCH_QUERIES: comma-separated names instead of the headline list.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from inkweave.plans import QUERIES

HEADLINE = [
    "backlink_counts",
    "txt1_extract_links",
    "jn3_neighborhood",
    "agg2_degrees",
    "agg3_pagerank_converged",
    "win1_top_k_similar",
    "win2_search",
    "jn4_note_info",
    "jn7_match_projects_strict",
    "jn9_suggest_projects",
    "txt11_apply_edits",
    "txt13_rewrite_links",
    "jn12_reconcile",
    "jn15_resolve_updates",
    "agg10_peer_registry",
    "win4_suppress_echo",
    "win9_retry_schedule",
    "jn16_classify_probes",
    "str4_membership",
    "str1_debounce_stream",
    "str3_suppress_echo_stream",
]


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
