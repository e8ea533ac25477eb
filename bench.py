"""Time every registered query and print one JSON line.

``BENCH_SF_DIR`` names the folder of the tables, ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES`` (optional, comma-separated) a part of the queries. Each query
runs once to warm up and is then timed; its rows are all computed and dropped.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from flowgauge.session import DEFAULTS  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "cfd_count_daily", "cfd_count_daily_by_project", "cfd_estimate_daily", "cfd_reports", "normalized_flow",
    "work_items_duration", "work_items_change_log", "work_items_count", "state_distinct_authors", "team_productivity",
    "work_items_count_by_state", "work_items_count_by_state_moving_average",
    "commits_stats", "commits_summary", "commits_by_namespace", "active_committers", "commits_by_role",
    "commits_by_role_namespace", "commits_by_category", "commits_by_category_namespace", "namespace_activity_rank",
    "repos_activity_rank", "committers_activity_rank", "committers_life_span", "committers_life_span_stats",
    "merge_requests_latest", "merge_requests_by_state", "merge_requests_by_author", "merge_requests_comments",
    "merge_requests_duration", "merge_requests_authors_ratio", "merge_requests_moving_average", "merge_requests_by_role",
    "merge_requests_by_category", "merge_request_stats_by_project", "merge_requests_seasonality",
    "work_items", "commit_points", "merge_request_points", "metric_store_newest", "query_rebucket_four_weeks",
)


def session() -> SparkSession:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def run(spark: SparkSession, name: str) -> float:
    started = time.perf_counter()
    registry.queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name)
        seconds[name] = round(run(spark, name), 3)
    scale = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
