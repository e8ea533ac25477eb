"""Run operators on rows of which a third have one key; print the task sizes of each as JSON.

Started by ``test_skew.py`` in its own process, as it needs an event log.
"""

import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowgauge.operators import commit_reports, cumulative, issue_reports, merge_request_reports  # noqa: E402
from flowgauge.operators.flow import normalize_statuses  # noqa: E402
from flowgauge.settings import FlowSpec  # noqa: E402

ROWS = 300_000
SPEC = FlowSpec({"open": 0, "todo": 1, "doing": 2, "done": 3}, "todo", "done")


def scattered(salt, modulus):
    return F.pmod(F.xxhash64("n", F.lit(salt)), F.lit(modulus)).cast("int")


def main(log_dir):
    spark = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.compress", "false")
        .config("spark.eventLog.dir", f"file:{log_dir}")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        # As small as these tables, so that skewed joins are split as they are at full size.
        .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64k")
        .config("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.range(0, ROWS, 1, 8).withColumnRenamed("id", "n")
    hot = F.col("n") % 3 == 0
    # All changes of the hot item fall in one hour.
    within_hour = F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), scattered(4, 60), scattered(5, 60))
    when = F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(scattered(1, 900), scattered(2, 24))
    statuses = rows.select(
        F.when(hot, "hot").otherwise(F.floor(F.col("n") / 12).cast("string")).alias("id"),
        F.when(hot, within_hour).otherwise(when).alias("statusCreated"),
        F.element_at(F.array(*[F.lit(name) for name in SPEC.reference_flow]), scattered(3, 4) + 1).alias("statusName"),
        F.col("n").alias("pos"),
    )
    project = F.when(hot, 0).otherwise(F.col("n") % 5000).cast("int")
    commits = rows.select(
        when.alias("createdAt"),
        F.lit("a / b").alias("namespace"),
        F.concat(F.lit("dev"), F.when(hot, 0).otherwise(F.col("n")).cast("string")).alias("committer"),
        (F.col("n") % 9000).cast("int").alias("additions"),
        F.lit(-1).alias("deletions"),
        F.lit(6).alias("total"),
        project.alias("projectId"),
    )
    requests = rows.select(
        when.alias("createdAt"),
        F.when(hot, 0).otherwise(F.col("n")).cast("int").alias("id"),
        project.alias("projectId"),
        F.lit("merged").alias("state"),
        F.lit("develop").alias("targetBranch"),
        F.col("n").alias("updatedAt"),
    )
    projects = spark.range(5000).select(
        F.col("id").cast("int"), F.lit("a / b").alias("name_with_namespace"), F.array(F.lit("ui")).alias("tag_list")
    )
    tags = spark.createDataFrame([("ui",)], "value string")
    # One period holds a third of all committers.
    one_month = rows.select(
        F.when(hot, F.lit("2021-01-01").cast("timestamp_ntz")).otherwise(when).alias("createdAt"),
        F.concat(F.lit("dev"), F.col("n").cast("string")).alias("committer"),
        F.pmod(F.xxhash64("n"), F.lit(10**12)).alias("additions"),
        F.lit(-1).alias("deletions"),
        F.lit(6).alias("total"),
    )
    # All changes of the hot item have the same time.
    at_once = statuses.withColumn("statusCreated", F.when(F.col("id") == "hot", F.lit("2020-01-01").cast("timestamp_ntz")).otherwise(F.col("statusCreated")))
    jobs = {
        "flow at one time": normalize_statuses(at_once, SPEC),
        "flow": cumulative.cumulative_flow(normalize_statuses(statuses, SPEC), "DAYS"),
        "stays": issue_reports.state_spans(statuses, "2024-01-01"),
        "commits by role": commit_reports.commits_by_role(projects, tags, commits, "WEEKS"),
        "ranks": commit_reports.committers_activity_rank(one_month, "MONTHS"),
        "merge requests": merge_request_reports.by_state(requests, projects, "develop", "WEEKS"),
    }
    for name, frame in jobs.items():
        spark.sparkContext.setJobDescription(name)
        frame.write.format("noop").mode("overwrite").save()
    spark.stop()

    names, reads = {}, {}
    for folder, _, files in os.walk(log_dir):
        for file in files:
            with open(os.path.join(folder, file)) as lines:
                for event in (json.loads(line) for line in lines if line.startswith("{")):
                    if event["Event"] == "SparkListenerStageSubmitted":
                        names[event["Stage Info"]["Stage ID"]] = event.get("Properties", {}).get("spark.job.description")
                    elif event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                        read = event["Task Metrics"]["Shuffle Read Metrics"].get("Total Records Read", 0)
                        reads.setdefault(event["Stage ID"], []).append(read)
    sizes = {}
    for stage, records in reads.items():
        sizes.setdefault(names.get(stage), []).append(records)
    print(json.dumps(sizes))


if __name__ == "__main__":
    main(sys.argv[1])
