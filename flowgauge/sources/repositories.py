"""Projects, tag vocabularies, commits and merge requests.

Raw rows are landed JSON; the stored tables are the metric tables ``commits`` and
``merge_requests``, in which times are UTC.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions.names import mapped, parent_namespace
from flowgauge.functions.time import (
    as_time,
    days_between,
    epoch_millis_to_time,
    parse_epoch_millis,
    parse_instant,
    parse_wall_date,
)
from flowgauge.schemas import NAMESPACE, PROJECT, RAW_COMMIT, RAW_MERGE_REQUEST
from flowgauge.sources.issues import ARRAY, LINES, read_json
from flowgauge.sources.json_arrays import FILE

BOT_PREFIXES = ("jenkins",)


def read_projects(spark: SparkSession, path: str, layout: str = ARRAY) -> DataFrame:
    return read_json(spark, path, PROJECT, layout).drop(FILE)


def read_namespaces(spark: SparkSession, path: str, layout: str = ARRAY) -> DataFrame:
    return read_json(spark, path, NAMESPACE, layout).drop(FILE)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One tag per line, as column ``value``."""
    return spark.read.text(path)


def read_raw_commits(spark: SparkSession, path: str, layout: str = LINES) -> DataFrame:
    """Landed commits; ``project_id`` says which project's log they came from."""
    return read_json(spark, path, RAW_COMMIT, layout).drop(FILE)


def read_raw_merge_requests(spark: SparkSession, path: str, layout: str = LINES) -> DataFrame:
    return read_json(spark, path, RAW_MERGE_REQUEST, layout).drop(FILE)


def clean_commits(
    raw: DataFrame,
    email_mapping: Mapping[str, str] | DataFrame,
    bot_prefixes: Sequence[str] = BOT_PREFIXES,
) -> DataFrame:
    """Drop commits of bots, then replace known e-mail addresses.

    A mapping from the config is looked up in place; a mapping table (columns
    ``email``, ``committer``) is joined. If it names several committers for one
    address, the first in alphabetical order counts. Commits without an address stay.
    """
    kept = raw
    for prefix in bot_prefixes:
        kept = kept.where(~F.coalesce(F.col("committer_email").startswith(prefix), F.lit(False)))
    if isinstance(email_mapping, Mapping):
        return kept.withColumn("committer_email", mapped("committer_email", email_mapping))
    known = email_mapping.groupBy(F.col("email").alias("committer_email")).agg(F.min("committer").alias("_known"))
    joined = kept.join(known, "committer_email", "left")
    return joined.withColumn("committer_email", F.coalesce("_known", "committer_email")).drop("_known")


def commit_points(raw: DataFrame, projects: DataFrame) -> DataFrame:
    """The stored table ``commits``: deletions become negative."""
    named = projects.select(
        F.col("id").alias("project_id"),
        F.col("name_with_namespace").alias("project"),
        parent_namespace("name", "name_with_namespace").alias("namespace"),
    )
    return raw.join(named, "project_id").select(
        parse_instant("created_at").alias("time"),
        "project",
        "namespace",
        F.col("committer_email").alias("committer"),
        F.col("project_id").cast("string").alias("projectId"),
        F.col("stats.additions").alias("additions"),
        (-F.col("stats.deletions")).alias("deletions"),
        (F.col("stats.additions") - F.col("stats.deletions")).alias("effective"),
        F.col("stats.total").alias("total"),
    )


def merge_request_points(raw: DataFrame, as_of) -> DataFrame:
    """The stored table ``merge_requests``; open requests last until ``as_of``."""
    merged_day = F.coalesce(parse_wall_date("merged_at"), as_time(as_of).cast("date"))
    return raw.select(
        parse_instant("created_at").alias("time"),
        F.col("id").cast("string").alias("id"),
        F.col("project_id").cast("string").alias("project_id"),
        F.col("author.username").alias("author"),
        "state",
        "source_branch",
        "target_branch",
        parse_epoch_millis("updated_at").alias("updated_at"),
        "user_notes_count",
        F.coalesce(parse_epoch_millis("merged_at"), F.lit(0).cast("long")).alias("merged_at_ts"),
        days_between(parse_wall_date("created_at"), merged_day).alias("duration_days"),
    )


def commits_of(points: DataFrame) -> DataFrame:
    """Commit records for the reports, from the stored table."""
    return points.select(
        F.col("time").alias("createdAt"),
        "project",
        "namespace",
        "committer",
        *[F.col(name).cast("int").alias(name) for name in ("additions", "deletions", "total", "effective", "projectId")],
    )


def merge_requests_of(points: DataFrame) -> DataFrame:
    """Merge-request records for the reports, from the stored table."""
    return points.select(
        F.col("time").alias("createdAt"),
        F.col("id").cast("int").alias("id"),
        F.col("project_id").cast("int").alias("projectId"),
        "author",
        "state",
        F.col("source_branch").alias("sourceBranch"),
        F.col("target_branch").alias("targetBranch"),
        F.col("user_notes_count").cast("int").alias("userNotesCount"),
        epoch_millis_to_time(F.nullif("merged_at_ts", F.lit(0))).alias("mergedAt"),
        F.col("updated_at").cast("long").alias("updatedAt"),
    )
