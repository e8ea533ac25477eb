"""Readers, work items and ingest against SQL."""

from __future__ import annotations

from checks import views
from flowgauge.functions.time import as_time
from flowgauge.operators import cumulative, flow, work_items
from flowgauge.plans import ingest
from flowgauge.session import scratch_path
from flowgauge.sinks.metric_store import MetricStore
from flowgauge.sources import increments, issues, repositories
from pyspark.sql import Window
from pyspark.sql import functions as F


def _items(spark, sf_dir):
    return issues.as_work_items(views.issues(spark, sf_dir), views.SETTINGS)


def _landed_issues(spark, sf_dir):
    """The same issues, written as JSON lines by project and read again."""
    path = scratch_path(spark, "issues")
    views.issues(spark, sf_dir).write.partitionBy("project").option("ignoreNullFields", "false").json(path)
    return issues.read_issues(spark, path, issues.LINES)


def _landed_pages(spark, sf_dir):
    """The same issues as search answers of one issue each, in the tracker's own field names."""
    path = scratch_path(spark, "pages")

    def tracker_item(item):
        named = [item[name].alias(name) for name in ("fieldId", "from", "fromString", "to")]
        return F.struct(*named, item["toStr"].alias("toString"))

    def tracker_history(history):
        return history.withField("items", F.transform(history["items"], tracker_item))

    histories = F.transform("changelog.histories", tracker_history)
    renamed = views.issues(spark, sf_dir).withColumn("changelog", F.struct(histories.alias("histories")))
    renamed.select(
        "project",
        F.lit(0).alias("startAt"),
        F.lit(1).alias("maxResults"),
        F.lit(1).alias("total"),
        F.array(F.struct("key", "fields", "changelog")).alias("issues"),
    ).write.partitionBy("project").json(path)
    return issues.read_issue_pages(spark, path, issues.LINES)


def _landed_arrays(spark, sf_dir, layout):
    """The same issues, landed as one JSON array in one file per project."""
    path = scratch_path(spark, "arrays")
    # Events are put in the order of a file before they become issues, as these are twenty times as wide.
    in_file = Window.partitionBy("file").orderBy("event_id")
    events = views.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    events = events.withColumn("file", F.concat(F.lit("P"), (F.col("user_id") % 3).cast("string")))
    events = events.withColumns({"place": F.row_number().over(in_file), "last": F.lead("event_id").over(in_file).isNull()})
    rows = views.issues(spark, sf_dir, events, ("file", "place", "last")).withColumn("project", F.col("file"))
    start = F.when(F.col("place") == 1, "[").otherwise(",")
    text = F.concat(start, F.to_json(F.struct("key", "fields", "changelog")), F.when(F.col("last"), "]").otherwise(""))
    rows.select("project", text.alias("value")).write.partitionBy("project").text(path)
    return issues.read_issues(spark, path, layout)


def _flat_items(items):
    return items.drop("statusHistory")


def _trimmed(spark, sf_dir):
    trimmed = work_items.trim_history_items(views.issues(spark, sf_dir))
    histories = F.col("changelog.histories")
    fields = F.flatten(F.transform(histories, lambda history: history["items"]["fieldId"]))
    return trimmed.select("key", F.size(histories).alias("histories"), F.array_join(fields, ",").alias("fields"))


def _trimmed_to_estimates(spark, sf_dir):
    """Changes without a text are left out first, so issues keep one to three histories."""

    def texts(history):
        return history.withField("items", F.filter(history["items"], lambda item: item["toStr"].isNotNull()))

    histories = F.transform("changelog.histories", texts)
    found = views.issues(spark, sf_dir).withColumn("changelog", F.col("changelog").withField("histories", histories))
    trimmed = work_items.trim_history_items(found, ("size_field", "points_field"))
    kept = F.col("changelog.histories")
    named = F.flatten(F.transform(kept, lambda h: F.transform(h["items"], lambda i: F.concat_ws("=", i["fieldId"], i["toStr"]))))
    return trimmed.select("key", F.size(kept).alias("histories"), F.array_join(named, ",").alias("changes"))


def _nested(spark, sf_dir):
    """Items that start, finish, reopen and go back: what one user does on one day, as one row with its history.

    They are landed and read again, as items with their histories are in use.
    """
    status = F.struct(
        F.col("statusCreated").alias("created"), "pos", F.col("statusName").alias("name"), F.col("statusAuthor").alias("author")
    )
    columns = ("project", "id", "type", "priority", "created", "estimate")
    items = views.statuses(spark, sf_dir).groupBy(*columns).agg(F.array_sort(F.collect_list(status)).alias("statusHistory"))
    return spark.read.parquet(_written(spark, "nested", items, "parquet"))


def _commit_points(spark, sf_dir, mapping=views.SETTINGS.email_mapping):
    cleaned = repositories.clean_commits(views.raw_commits(spark, sf_dir), mapping)
    return repositories.commit_points(cleaned, views.projects(spark, sf_dir))


def _email_table(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("dev"), F.col("c_custkey").cast("string"), F.lit("@corp.example")).alias("email"),
        F.col("c_name").alias("committer"),
    )


def _merge_request_points(spark, sf_dir):
    return repositories.merge_request_points(views.raw_merge_requests(spark, sf_dir), views.AS_OF)


def _next_load(spark, sf_dir):
    """The next load after a store that ends in 1998."""
    points = _commit_points(spark, sf_dir)
    stored = points.where(F.col("time") < as_time("1998-07-01"))
    return increments.within(points, increments.commit_window(stored, views.AS_OF))


def _next_merge_requests(spark, sf_dir):
    points = _merge_request_points(spark, sf_dir)
    stored = points.where(F.col("time") < as_time("2000-07-01"))
    return increments.within(points, increments.merge_request_window(stored, views.AS_OF))


def _written(spark, name, df, kind="json"):
    path = scratch_path(spark, name)
    # Landed JSON is packed, in files of which a task can read one.
    packed = {"compression": "gzip", "maxRecordsPerFile": 500_000} if kind == "json" else {}
    df.write.format(kind).options(**packed).save(path)
    return path


def _projects_from_json(spark, sf_dir):
    path = _written(spark, "projects", views.projects(spark, sf_dir))
    read = repositories.read_projects(spark, path, issues.LINES)
    return read.withColumn("tag_list", F.array_join("tag_list", ","))


def _vocabulary_from_text(spark, sf_dir):
    return repositories.read_vocabulary(spark, _written(spark, "roles", views.roles(spark, sf_dir), "text"))


def _versions_from_json(spark, sf_dir):
    key = F.col("s_suppkey")
    versions = views.table(spark, sf_dir, "supplier").select(
        (key % 7).cast("int").alias("projectId"),
        key.cast("string").alias("id"),
        F.col("s_name").alias("name"),
        (key % 2 == 0).alias("archived"),
        (key % 3 == 0).alias("released"),
        F.date_add(F.lit("2020-01-01").cast("date"), key.cast("int")).alias("startDate"),
        F.when(key % 3 == 0, F.lit("2021-01-01").cast("date")).alias("releaseDate"),
        F.concat(F.lit("P"), (key % 7).cast("string")).alias("project"),
    )
    path = scratch_path(spark, "versions")
    versions.write.partitionBy("project").json(path)
    return issues.read_versions(spark, path, issues.LINES)


def _commits_through_store(spark, sf_dir):
    """Landed as JSON, ingested in two overlapping loads, read back as records."""
    raw = repositories.read_raw_commits(spark, _written(spark, "commits", views.raw_commits(spark, sf_dir)))
    store = MetricStore(spark, scratch_path(spark, "store"))
    for load_id, window in ((1, ("1990-01-01", "1999-06-30")), (2, ("1999-01-01", "2010-01-01"))):
        ingest.ingest_commits(store, load_id, raw, views.projects(spark, sf_dir), views.SETTINGS, window)
    return ingest.load_commits(store)


def _merge_requests_through_store(spark, sf_dir):
    landed = _written(spark, "requests", views.raw_merge_requests(spark, sf_dir))
    store = MetricStore(spark, scratch_path(spark, "store"))
    for load_id in (1, 2):
        ingest.ingest_merge_requests(store, load_id, repositories.read_raw_merge_requests(spark, landed), views.AS_OF)
    return ingest.load_merge_requests(store).select("id", "createdAt", "state", "author", "targetBranch").distinct()


def queries():
    return {
        "projects_from_json": _projects_from_json,
        "vocabulary_from_text": _vocabulary_from_text,
        "project_versions_from_json": _versions_from_json,
        "commits_through_store": _commits_through_store,
        "merge_requests_through_store": _merge_requests_through_store,
        "work_items": lambda s, d: _flat_items(_items(s, d)),
        "work_items_from_json": lambda s, d: _flat_items(issues.as_work_items(_landed_issues(s, d), views.SETTINGS)),
        "work_items_from_arrays": lambda s, d: _flat_items(
            issues.as_work_items(_landed_arrays(s, d, issues.ARRAY), views.SETTINGS)
        ),
        "work_items_from_split_arrays": lambda s, d: _flat_items(
            issues.as_work_items(_landed_arrays(s, d, issues.SPLIT), views.SETTINGS)
        ),
        "work_items_from_pages": lambda s, d: _flat_items(issues.as_work_items(_landed_pages(s, d), views.SETTINGS)),
        "work_item_statuses": lambda s, d: work_items.flatten(_items(s, d)).select(
            "id", "statusCreated", "statusName", "statusAuthor"
        ),
        "work_items_truncated": lambda s, d: work_items.truncate_times(work_items.flatten(_items(s, d)), "WEEKS").select(
            "id", "created", "closed", "statusCreated", "statusName"
        ),
        "normalized_nested_items": lambda s, d: flow.normalize_items(_items(s, d), views.FLOW).select(
            "project", "id", "entry_at", "final_at"
        ),
        "cfd_from_nested_items": lambda s, d: cumulative.flow_table(
            _items(s, d), views.FLOW, "DAYS", aggregate="estimate", series=("project",)
        ).withColumn("th", F.round("th", 6)),
        "trimmed_issues": _trimmed,
        "trimmed_issues_estimates": _trimmed_to_estimates,
        "normalized_nested_histories": lambda s, d: flow.normalize_items(_nested(s, d), views.FLOW).select(
            "project", "id", "type", "estimate", "entry_at", "final_at"
        ),
        "cfd_from_nested_histories": lambda s, d: cumulative.flow_table(
            _nested(s, d), views.FLOW, "DAYS", series=("project",)
        ).withColumn("th", F.round("th", 6)),
        "commit_points": _commit_points,
        "commit_points_mapping_table": lambda s, d: _commit_points(s, d, _email_table(s, d)),
        "commit_records": lambda s, d: repositories.commits_of(_commit_points(s, d)),
        "merge_request_points": _merge_request_points,
        "merge_request_records": lambda s, d: repositories.merge_requests_of(_merge_request_points(s, d)),
        "last_commit_time": lambda s, d: increments.high_water_mark(_commit_points(s, d)),
        "next_commit_load": _next_load,
        "next_merge_request_load": _next_merge_requests,
    }


_COMMIT_POINTS = """
commit_points AS (
  SELECT "time", name_with_namespace AS project, namespace, {committer} AS committer, CAST(project_id AS VARCHAR) AS projectId,
         added AS additions, -removed AS deletions, added - removed AS effective, added + removed AS total
  FROM raw_commits JOIN projects p ON p.id = project_id {join})
"""
_MAPPED = _COMMIT_POINTS.format(
    committer="CASE email WHEN 'dev1@corp.example' THEN 'dev2@corp.example' "
    "WHEN 'dev7@mail-x.example' THEN 'dev8@corp.example' ELSE email END",
    join="",
)
_TABLE_MAPPED = _COMMIT_POINTS.format(
    committer="coalesce(c_name, email)", join="LEFT JOIN customer ON 'dev' || c_custkey || '@corp.example' = email"
)
_REQUEST_POINTS = f"""
request_points AS (
  SELECT createdAt - INTERVAL 2 HOUR AS "time", CAST(id AS VARCHAR) AS id, CAST(projectId AS VARCHAR) AS project_id, author, state,
         sourceBranch AS source_branch, targetBranch AS target_branch, updatedAt - 7200000 AS updated_at,
         userNotesCount AS user_notes_count, coalesce(epoch_ms(mergedAt) - 7200000, 0) AS merged_at_ts,
         date_diff('day', CAST(createdAt AS DATE), CAST(coalesce(mergedAt, TIMESTAMP '{views.AS_OF}') AS DATE)) AS duration_days
  FROM merge_requests)
"""


def oracle_sql():
    from checks import flow_checks
    from checks.flow_checks import _table

    walked = flow_checks.oracle_sql()

    items = f"WITH {views.ISSUES_SQL} SELECT * EXCLUDE (event_id) FROM work_items"
    statuses = "FROM changes c JOIN base b ON b.event_id = c.event_id WHERE field = 'status'"
    # At most two statuses per issue, `signup` an hour after creation and the event
    # itself after 0 to 2 hours: entry and final state follow from the event alone.
    nested = (
        f"WITH RECURSIVE {views.ISSUES_SQL}, "
        "ordered AS (SELECT event_id, t, text_, row_number() OVER (PARTITION BY event_id ORDER BY t, pos) AS rn "
        "FROM changes WHERE field = 'status' AND text_ <> 'error'), "
        "lasts AS (SELECT event_id, max(t) FILTER (text_ = 'view') AS entry, max(rn) FILTER (text_ = 'view') AS ve, "
        "max(rn) FILTER (text_ = 'signup') AS vs, count(*) FILTER (text_ = 'signup') AS signups FROM ordered GROUP BY event_id), "
        "normalized AS (SELECT project, id, estimate, entry AS entry_at, CAST(NULL AS TIMESTAMP) AS final_at "
        "FROM lasts l JOIN work_items w ON w.event_id = l.event_id WHERE ve > vs)"
    )
    commits = f"WITH {views.RAW_COMMITS_SQL}, {views.PROJECTS_SQL}"
    requests = f"WITH {views.MERGE_REQUESTS_SQL}, {_REQUEST_POINTS}"
    return {
        "projects_from_json": (
            f"WITH {views.PROJECTS_SQL} SELECT id, name, name_with_namespace, roleTag || ',' || catTag || ',noise' AS tag_list "
            "FROM projects"
        ),
        "vocabulary_from_text": "SELECT 'role' || r_regionkey AS \"value\" FROM region WHERE r_regionkey < 2",
        "project_versions_from_json": (
            "SELECT 'P' || (s_suppkey % 7) AS project, CAST(s_suppkey % 7 AS INTEGER) AS projectId, "
            "CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_suppkey % 2 = 0 AS archived, s_suppkey % 3 = 0 AS released, "
            "DATE '2020-01-01' + CAST(s_suppkey AS INTEGER) AS startDate, "
            "CASE WHEN s_suppkey % 3 = 0 THEN DATE '2021-01-01' END AS releaseDate FROM supplier"
        ),
        # Commits of one project, committer and time are one point.
        "commits_through_store": (
            f"{commits}, {_MAPPED} SELECT \"time\" AS createdAt, project, namespace, committer, additions, deletions, total, "
            "effective, CAST(projectId AS INTEGER) AS projectId FROM commit_points "
            'QUALIFY row_number() OVER (PARTITION BY "time", project, namespace, committer, projectId '
            "ORDER BY additions DESC, deletions DESC, effective DESC, total DESC) = 1"
        ),
        "merge_requests_through_store": (
            f"WITH {views.MERGE_REQUESTS_SQL} SELECT DISTINCT id, createdAt - INTERVAL 2 HOUR AS createdAt, state, author, "
            "targetBranch FROM merge_requests"
        ),
        "work_items": items,
        "work_items_from_json": items,
        "work_items_from_arrays": items,
        "work_items_from_split_arrays": items,
        "work_items_from_pages": items,
        "work_item_statuses": (
            f"WITH {views.ISSUES_SQL} SELECT 'I-' || c.event_id AS id, t AS statusCreated, text_ AS statusName, "
            f"author AS statusAuthor {statuses}"
        ),
        "work_items_truncated": (
            f"WITH {views.ISSUES_SQL} SELECT 'I-' || c.event_id AS id, CAST(date_trunc('week', t0) AS TIMESTAMP) AS created, "
            "CASE WHEN event_type = 'purchase' THEN t0 + INTERVAL 3 DAY END AS closed, "
            f"CAST(date_trunc('week', t) AS TIMESTAMP) AS statusCreated, text_ AS statusName {statuses}"
        ),
        "normalized_nested_items": f"{nested} SELECT project, id, entry_at, final_at FROM normalized",
        "cfd_from_nested_items": f"{nested}, {_table('day', '1 DAY', 'project, ', 'estimate', 'DOUBLE')} SELECT * FROM t",
        "trimmed_issues": (
            "SELECT 'I-' || event_id AS \"key\", 3 AS histories, 'status,status,fixVersions' AS fields FROM events"
        ),
        "trimmed_issues_estimates": (
            f"WITH {views.ISSUES_SQL} SELECT 'I-' || event_id AS \"key\", "
            "CAST(count(DISTINCT CASE WHEN pos < 2 THEN 1 WHEN pos < 4 THEN 2 ELSE 3 END) AS INTEGER) AS histories, "
            "string_agg(field || '_field=' || text_, ',' ORDER BY pos) AS changes "
            "FROM changes WHERE field IN ('size', 'points') AND text_ IS NOT NULL GROUP BY event_id"
        ),
        # The recursive walk over the flat rows of the same items.
        "normalized_nested_histories": walked["normalized_flow"],
        "cfd_from_nested_histories": walked["cfd_count_daily_by_project"],
        "commit_points": f"{commits}, {_MAPPED} SELECT * FROM commit_points",
        "commit_points_mapping_table": f"{commits}, {_TABLE_MAPPED} SELECT * FROM commit_points",
        "commit_records": (
            f'{commits}, {_MAPPED} SELECT "time" AS createdAt, project, namespace, committer, additions, deletions, total, '
            "effective, CAST(projectId AS INTEGER) AS projectId FROM commit_points"
        ),
        "merge_request_points": f"{requests} SELECT * FROM request_points",
        "merge_request_records": (
            f"WITH {views.MERGE_REQUESTS_SQL} SELECT createdAt - INTERVAL 2 HOUR AS createdAt, id, projectId, author, state, "
            "sourceBranch, targetBranch, userNotesCount, mergedAt - INTERVAL 2 HOUR AS mergedAt, "
            "updatedAt - 7200000 AS updatedAt FROM merge_requests"
        ),
        "last_commit_time": f'{commits}, {_MAPPED} SELECT max("time") AS "last" FROM commit_points',
        "next_commit_load": (
            f"{commits}, {_MAPPED}, mark AS (SELECT max(\"time\") AS last_ FROM commit_points "
            "WHERE \"time\" < TIMESTAMP '1998-07-01') SELECT c.* FROM commit_points c, mark "
            'WHERE "time" BETWEEN last_ AND last_ + INTERVAL 12 MONTH'
        ),
        "next_merge_request_load": (
            f"{requests}, mark AS (SELECT max(\"time\") AS last_ FROM request_points "
            "WHERE \"time\" < TIMESTAMP '2000-07-01') SELECT c.* FROM request_points c, mark "
            'WHERE "time" BETWEEN last_ - INTERVAL 12 MONTH AND last_ - INTERVAL 12 MONTH + INTERVAL 24 MONTH'
        ),
    }
