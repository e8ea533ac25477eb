"""Issues and project versions from landed JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.operators.work_items import work_items
from flowgauge.schemas import VERSION, issue_page_schema, issue_schema
from flowgauge.settings import Settings
from flowgauge.sources.json_arrays import FILE, read_json_arrays

# One file per project, with the project key in its name.
PROJECT_IN_FILE_NAME = r"issues-(.+?)\.json"
VERSIONS_FILE_NAME = r"versions-(.+?)\.json"

ARRAY = "array"
LINES = "lines"
SPLIT = "split"


def read_json(spark: SparkSession, path: str, schema: str, layout: str = ARRAY) -> DataFrame:
    """JSON rows of a fixed schema; a malformed file is an error.

    ``array`` files hold one JSON array each, or one object; ``split`` files hold one array and nothing else will do. Many
    tasks read a large file of either, and none holds more than one record. ``lines`` is cheapest for large extracts, as
    Spark reads it once.
    """
    if layout not in (ARRAY, LINES, SPLIT):
        raise ValueError(f"layout must be {ARRAY!r}, {LINES!r} or {SPLIT!r}, got {layout!r}")
    if layout != LINES:
        return read_json_arrays(spark, path, schema, any_root=layout == ARRAY)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _with_project(rows: DataFrame, pattern: str) -> DataFrame:
    """Add the project key: from a ``project=…`` folder if there is one, else from the path."""
    file = FILE if FILE in rows.columns else "_metadata.file_path"
    if "project" not in rows.columns:
        rows = rows.withColumn("project", F.regexp_extract(F.col(file), pattern, 1))
    return rows.drop(FILE)


def read_issues(
    spark: SparkSession, path: str, layout: str = ARRAY, project_pattern: str = PROJECT_IN_FILE_NAME
) -> DataFrame:
    """Saved issues of all projects below ``path``, with their ``project``."""
    return _with_project(read_json(spark, path, issue_schema(), layout), project_pattern)


def read_issue_pages(
    spark: SparkSession, path: str, layout: str = ARRAY, project_pattern: str = PROJECT_IN_FILE_NAME
) -> DataFrame:
    """Issues from saved search answers, in the same shape as :func:`read_issues`."""
    pages = _with_project(read_json(spark, path, issue_page_schema(), layout), project_pattern)
    return as_saved(pages.select("project", F.inline("issues")))


def as_saved(issues: DataFrame) -> DataFrame:
    """Rename ``toString`` of every change to ``toStr``."""

    def saved_item(item: Column) -> Column:
        return F.struct(
            item["fieldId"].alias("fieldId"),
            item["from"].alias("from"),
            item["fromString"].alias("fromString"),
            item["to"].alias("to"),
            item["toString"].alias("toStr"),
        )

    histories = F.transform(
        "changelog.histories", lambda history: history.withField("items", F.transform(history["items"], saved_item))
    )
    return issues.withColumn("changelog", F.col("changelog").withField("histories", histories))


def read_work_items(
    spark: SparkSession, path: str, settings: Settings, layout: str = ARRAY, time_mode: str = "wall_clock"
) -> DataFrame:
    """Work items of all configured projects, sized by the project's own mapping."""
    return as_work_items(read_issues(spark, path, layout), settings, time_mode)


def as_work_items(issues: DataFrame, settings: Settings, time_mode: str = "wall_clock") -> DataFrame:
    """Work items from issues with a ``project`` column."""
    by_project = []
    for project, flow in settings.flows.items():
        sizes = [F.lit(part) for size, points in flow.estimate_mapping.items() for part in (size, float(points))]
        by_project += [F.lit(project), F.create_map(*sizes) if sizes else F.lit(None).cast("map<string,double>")]
    sizes_of = F.try_element_at(F.create_map(*by_project), F.col("project")) if by_project else None
    return work_items(
        issues,
        sizes_of if sizes_of is not None else {},
        settings.estimate_field,
        settings.story_points_field,
        settings.epic_name_field,
        time_mode,
    )


def read_versions(
    spark: SparkSession, path: str, layout: str = ARRAY, project_pattern: str = VERSIONS_FILE_NAME
) -> DataFrame:
    return _with_project(read_json(spark, path, VERSION, layout), project_pattern)
