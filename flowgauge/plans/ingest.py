"""From landed files to the stored tables of commits and merge requests."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowgauge.plans.catalogue import tags_of
from flowgauge.settings import Settings
from flowgauge.sinks.metric_store import MetricStore
from flowgauge.sources import increments, repositories
from flowgauge.sources.increments import Window, within


def ingest_commits(
    store: MetricStore, load_id: int, raw: DataFrame, projects: DataFrame, settings: Settings, window: Window | None = None
) -> None:
    """Clean landed commits and append those of the window (all without one)."""
    cleaned = repositories.clean_commits(raw, settings.email_mapping)
    points = repositories.commit_points(cleaned, projects)
    store.append(points if window is None else within(points, window), "commits", load_id, tags_of("commits"))


def ingest_merge_requests(store: MetricStore, load_id: int, raw: DataFrame, as_of, window: Window | None = None) -> None:
    points = repositories.merge_request_points(raw, as_of)
    store.append(points if window is None else within(points, window), "merge_requests", load_id, tags_of("merge_requests"))


def next_commits(store: MetricStore, as_of) -> Window:
    """Window of the next load of commits."""
    return increments.commit_window(store.last_month("commits"), as_of)


def next_merge_requests(store: MetricStore, as_of) -> Window:
    """Window of the next load of merge requests."""
    return increments.merge_request_window(store.last_month("merge_requests"), as_of)


def load_commits(store: MetricStore, since=None, until=None) -> DataFrame:
    """Commit records for the reports."""
    return repositories.commits_of(store.read("commits", tags_of("commits"), since, until))


def load_merge_requests(store: MetricStore, since=None, until=None) -> DataFrame:
    """Merge-request records for the reports, one row per stored version."""
    return repositories.merge_requests_of(store.read("merge_requests", tags_of("merge_requests"), since, until))
