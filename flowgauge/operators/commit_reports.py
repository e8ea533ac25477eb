"""Reports on commits: activity, ranks, committers and their life spans.

Stored deletions are negative, so ``effective = additions - deletions`` is churn:
all lines touched. ``net=True`` adds ``effective_net``, lines gained.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions.distinct import distinct_sketch
from flowgauge.functions.names import contains_none_of, root_namespace
from flowgauge.functions.time import complete_units_of_time, period_start
from flowgauge.operators.ranking import dense_ranks

MEASURES = ("additions", "deletions", "total")
RANKS = {name: f"{name}Rank" for name in (*MEASURES, "effective")}

# Times of the first and last commit of a row; a table with these columns is a roll-up.
FIRST, LAST = "firstAt", "lastAt"


def commit_rollup(commits: DataFrame, unit: str) -> DataFrame:
    """One row per period, namespace, project, committer and project id; ``createdAt`` is the start of the period.

    It takes the place of the commits in every report of this bucket size, or of one made of whole such buckets, and
    in life spans of any unit. Sums of sums and the ends of a span are the same, nulls in any column included.
    """
    return commits.groupBy(
        period_start(unit, "createdAt").alias("createdAt"), "namespace", "project", "committer", "projectId"
    ).agg(
        *[F.sum(name).alias(name) for name in MEASURES],
        F.min("createdAt").alias(FIRST),
        F.max("createdAt").alias(LAST),
    )


def project_rollup(commits: DataFrame, unit: str) -> DataFrame:
    """One row per period, namespace and project id, for reports that ask for neither projects by name nor committers."""
    return commits.groupBy(period_start(unit, "createdAt").alias("createdAt"), "namespace", "projectId").agg(
        *[F.sum(name).alias(name) for name in MEASURES]
    )


def tag_rollup(commits: DataFrame, tags: DataFrame, unit: str, tag: str) -> DataFrame:
    """One row per period, namespace and tag, for reports by this tag; ``tags`` are those of ``project_tags``."""
    return (
        commits.join(tags, F.col("projectId") == F.col("id"))
        .groupBy(period_start(unit, "createdAt").alias("createdAt"), "namespace", tag)
        .agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    )


def committer_rollup(commits: DataFrame) -> DataFrame:
    """One row per committer with the first and last commit time, for life spans of any unit."""
    first, last = _ends(commits)
    return commits.groupBy("committer").agg(F.min(first).alias(FIRST), F.max(last).alias(LAST))


def _ends(commits: DataFrame) -> tuple[str, str]:
    return (FIRST, LAST) if {FIRST, LAST} <= set(commits.columns) else ("createdAt", "createdAt")


def _activity(commits: DataFrame, unit: str, keys: Sequence[str], net: bool = False) -> DataFrame:
    sums = (
        commits.groupBy(period_start(unit, "createdAt").alias("created"), *keys)
        .agg(*[F.sum(name).alias(name) for name in MEASURES])
        .withColumn("effective", F.col("additions") - F.col("deletions"))
    )
    return sums.withColumn("effective_net", F.col("additions") + F.col("deletions")) if net else sums


def _with_root(commits: DataFrame) -> DataFrame:
    return commits.withColumn("rootNamespace", root_namespace("namespace"))


def commits_stats(commits: DataFrame, unit: str, net: bool = False) -> DataFrame:
    return _activity(commits, unit, ("namespace", "project", "committer"), net)


def commits_summary(commits: DataFrame, unit: str, net: bool = False) -> DataFrame:
    return _activity(_with_root(commits), unit, ("rootNamespace",), net)


def commits_by_namespace(commits: DataFrame, unit: str, net: bool = False) -> DataFrame:
    return _activity(commits, unit, ("namespace",), net)


def active_committers(commits: DataFrame, unit: str, sketch_bits: int | None = None) -> DataFrame:
    """Committers per period and root namespace; with ``sketch_bits`` a ``sketch`` of them for longer periods."""
    return (
        _with_root(commits)
        .groupBy(period_start(unit, "createdAt").alias("created"), "rootNamespace")
        .agg(F.count_distinct("committer").alias("count"), *distinct_sketch("committer", sketch_bits))
    )


def project_tags(projects: DataFrame, vocabulary: DataFrame, name: str) -> DataFrame:
    """``id`` and tag of every project tag that is in the vocabulary (column ``value``)."""
    tags = projects.select("id", F.explode("tag_list").alias("value"))
    return tags.join(vocabulary.select("value"), "value").select("id", F.col("value").alias(name))


def _by_tag(
    commits: DataFrame, projects: DataFrame, vocabulary: DataFrame, unit: str, tag: str, keys: Sequence[str]
) -> DataFrame:
    """Sums per period and tag; a roll-up by the tag has met the projects already."""
    sums = [F.sum(name).alias(name) for name in ("additions", "deletions")]
    if tag in commits.columns:
        return commits.groupBy(period_start(unit, "createdAt").alias("ts"), tag, *keys).agg(*sums)
    # Summed per project first: the join then sees one row per project and period,
    # however many commits a project has.
    per_project = commits.groupBy(period_start(unit, "createdAt").alias("ts"), F.col("projectId").alias("id"), *keys).agg(*sums)
    return per_project.join(project_tags(projects, vocabulary, tag), "id").groupBy("ts", tag, *keys).agg(*sums)


def commits_by_role(projects: DataFrame, roles: DataFrame, commits: DataFrame, unit: str) -> DataFrame:
    return _by_tag(commits, projects, roles, unit, "role", ())


def commits_by_role_namespace(projects: DataFrame, roles: DataFrame, commits: DataFrame, unit: str) -> DataFrame:
    return _by_tag(commits, projects, roles, unit, "role", ("namespace",))


def commits_by_category(projects: DataFrame, categories: DataFrame, commits: DataFrame, unit: str) -> DataFrame:
    return _by_tag(commits, projects, categories, unit, "category", ())


def commits_by_category_namespace(
    projects: DataFrame, categories: DataFrame, commits: DataFrame, unit: str
) -> DataFrame:
    return _by_tag(commits, projects, categories, unit, "category", ("namespace",))


def _activity_rank(commits: DataFrame, unit: str, key: str, top_k: int | None) -> DataFrame:
    """Ranks per period, 1 for the least active; with ``top_k``, those with the most lines only."""
    ranks = {rank: F.col(measure) for measure, rank in RANKS.items()}
    if top_k is not None:
        ranks["place"] = -F.col("total")
    ranked = dense_ranks(_activity(commits, unit, (key,)), ("created",), ranks)
    if top_k is not None:
        ranked = ranked.where(F.col("place") <= top_k)
    return ranked.select("created", key, *MEASURES, "effective", *RANKS.values())


def namespace_activity_rank(commits: DataFrame, unit: str, top_k: int | None = None) -> DataFrame:
    return _activity_rank(commits, unit, "namespace", top_k)


def repos_activity_rank(commits: DataFrame, unit: str, top_k: int | None = None) -> DataFrame:
    return _activity_rank(commits, unit, "project", top_k)


def committers_activity_rank(commits: DataFrame, unit: str, top_k: int | None = None) -> DataFrame:
    return _activity_rank(commits, unit, "committer", top_k)


def committers_life_span(commits: DataFrame, unit: str, excluded_parts: Sequence[str] = ("-",)) -> DataFrame:
    """Units from first to last commit, both counted, by period of the first one.

    Committers whose name contains an excluded part (such as a foreign mail
    domain), or who have a single commit time, are left out.
    """
    first, last = _ends(commits)
    spans = (
        commits.where(contains_none_of("committer", excluded_parts))
        .groupBy("committer")
        .agg(F.min(first).alias("start"), F.max(last).alias("end"))
        .where(F.col("start") != F.col("end"))
    )
    return spans.withColumns(
        {"ts": period_start(unit, "start"), "duration": complete_units_of_time(unit, "start", "end") + 1}
    )


def committers_life_span_stats(commits: DataFrame, unit: str, excluded_parts: Sequence[str] = ("-",)) -> DataFrame:
    """Life spans per first period, with the mean of all means so far."""
    return (
        committers_life_span(commits, unit, excluded_parts)
        .groupBy("ts")
        .agg(F.count("duration").alias("durationCount"), F.sum("duration").alias("durationTotal"))
        .withColumn("durationAvg", F.col("durationTotal") / F.col("durationCount"))
        # One row per period here, so a window over all of them stays small.
        .withColumn("durationMovAvg", F.avg("durationAvg").over(Window.orderBy("ts")))
    )
