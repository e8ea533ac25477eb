"""Cumulative flow on request: parameters in, table and averages out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from flowgauge.functions.time import DAYS, WEEKS
from flowgauge.operators.cumulative import COUNT, ESTIMATE, averages, flow_table, with_report_columns
from flowgauge.settings import Settings
from flowgauge.sinks.report_cache import cached, source_version
from flowgauge.sources.issues import ARRAY, read_work_items


@dataclass(frozen=True)
class FlowRequest:
    """What is asked for; an empty list of types or priorities means all of them."""

    project: str
    interval: str = "week"
    types: Sequence[str] = ()
    priorities: Sequence[str] = ()
    aggregate: str = "count"
    start: str | None = None
    entry_state: str | None = None
    final_state: str | None = None

    @property
    def unit(self) -> str:
        return DAYS if self.interval == "day" else WEEKS


def flow_on_request(items: DataFrame, settings: Settings, request: FlowRequest) -> DataFrame:
    """Flow table of one project, with state-independent column names."""
    spec = settings.flows[request.project].between(request.entry_state, request.final_state)
    of_project = items.where(items["project"] == request.project) if "project" in items.columns else items
    return flow_table(
        of_project,
        spec,
        request.unit,
        aggregate=COUNT if request.aggregate == "count" else ESTIMATE,
        types=list(request.types) or None,
        priorities=list(request.priorities) or None,
        created_after=request.start,
    )


def flow_answer(items: DataFrame, settings: Settings, request: FlowRequest) -> tuple[DataFrame, DataFrame]:
    """The table under its report column names, and its averages; both lazy."""
    table = flow_on_request(items, settings, request)
    spec = settings.flows[request.project].between(request.entry_state, request.final_state)
    return with_report_columns(table, spec), averages(table)


def cached_flow(spark, issues_path: str, cache_root: str, settings: Settings, request: FlowRequest, layout: str = ARRAY) -> DataFrame:
    """Flow table from issue files, kept until the request, the settings or the files change."""
    parameters = {"request": request, "settings": settings, "source": source_version(spark, issues_path)}

    def build() -> DataFrame:
        return flow_on_request(read_work_items(spark, issues_path, settings, layout), settings, request)

    return cached(spark, cache_root, parameters, build)


def cached_averages(spark, issues_path: str, cache_root: str, settings: Settings, request: FlowRequest, layout: str = ARRAY) -> DataFrame:
    """One row of averages of the cached flow table, which is made if it is not there; kept like the table."""
    parameters = {"request": request, "settings": settings, "source": source_version(spark, issues_path), "part": "averages"}
    return cached(
        spark, cache_root, parameters, lambda: averages(cached_flow(spark, issues_path, cache_root, settings, request, layout))
    )
