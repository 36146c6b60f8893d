"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from broadsheet.checks.queries import queries

HEADLINE = (
    "search_keyword",
    "search_clean",
    "search_titles",
    "search_cap_per_year",
    "search_counts_by_year",
    "token_counts",
    "colloc_metrics",
    "colloc_metrics_word",
    "colloc_metrics_stopwords",
    "colloc_by_month",
    "colloc_by_2weeks",
    "rank_global",
    "drop_candidates",
    "locate_articles",
    "occurrences",
    "map_groups",
    "map_radii",
    "heat_frames",
    "map_entries",
    "attribute_table",
)


def session(cores: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("broadsheet-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="broadsheet-bench-"))
        .getOrCreate()
    )


def timed(query, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    every = queries()
    names = sys.argv[1:] or HEADLINE
    timed(every["search_keyword"], spark, sf_dir)  # starts the session's threads and caches
    seconds = {name: round(min(timed(every[name], spark, sf_dir) for _ in range(3)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cores": int(cores),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
