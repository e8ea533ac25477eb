"""Activity tables derived from the generated tables, in Spark and in SQL.

The generated data has no issues, commits or merge requests. Each is derived row
by row from one table, so that a query's cost is that of the operator; the SQL
gives the same rows for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.settings import FlowReport, FlowSpec, Settings

AS_OF = "2024-02-15 12:00:00"

FLOW = FlowSpec(
    reference_flow={"signup": 0, "view": 1, "click": 2, "purchase": 3},
    entry_state="view",
    final_state="purchase",
)
# A second flow with renamed states: an error sends the item back to its start.
MAPPED_FLOW = FlowSpec(
    reference_flow={"open": 0, "view": 1, "click": 2, "purchase": 3},
    entry_state="view",
    final_state="click",
    state_mapping={"error": "open", "signup": "open"},
)
REPORTS = (
    FlowReport("All stories and bugs", ("Story", "Bug"), None, unit="WEEKS"),
    FlowReport("All stories", ("Story",), None, unit="WEEKS"),
    FlowReport("All bugs", ("Bug",), None, unit="WEEKS"),
    FlowReport("Critical bugs", ("Bug",), ("Critical",), unit="DAYS"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes: an item is what one user does on one day."""
    user, by_user = F.col("user_id"), lambda n: F.col("user_id") % n
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("P"), by_user(3).cast("string")).alias("project"),
        F.concat_ws("-", user.cast("string"), F.date_format(F.col("ts").cast("date"), "yyyyMMdd")).alias("id"),
        F.concat(F.lit("item of "), user.cast("string")).alias("name"),
        F.when(by_user(2) == 0, "Story").otherwise("Bug").alias("type"),
        F.when(by_user(3) == 0, "Critical").when(by_user(3) == 1, "High").otherwise("Low").alias("priority"),
        F.col("ts").cast("date").cast("timestamp_ntz").alias("created"),
        F.lit(None).cast("timestamp_ntz").alias("closed"),
        F.concat(F.lit("u"), by_user(10).cast("string")).alias("createdBy"),
        F.lit(None).cast("string").alias("size"),
        (by_user(5) + 1).cast("double").alias("estimate"),
        F.when(by_user(4) > 0, F.concat(F.lit("epic"), by_user(4).cast("string"))).alias("epicName"),
        F.col("ts").alias("statusCreated"),
        F.col("event_type").alias("statusName"),
        F.when(
            F.col("value") >= 2,
            F.concat(F.lit("a"), (F.get_json_object("props", "$.k").cast("int") % 20).cast("string")),
        ).alias("statusAuthor"),
        F.col("event_id").alias("pos"),
    )


STATUSES_SQL = """
statuses AS (
  SELECT 'P' || (user_id % 3) AS project,
         user_id || '-' || strftime(ts, '%Y%m%d') AS id,
         'item of ' || user_id AS name,
         CASE WHEN user_id % 2 = 0 THEN 'Story' ELSE 'Bug' END AS "type",
         CASE user_id % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' ELSE 'Low' END AS priority,
         CAST(CAST(ts AS DATE) AS TIMESTAMP) AS created,
         'u' || (user_id % 10) AS createdBy,
         CAST(user_id % 5 + 1 AS DOUBLE) AS estimate,
         CASE WHEN user_id % 4 > 0 THEN 'epic' || (user_id % 4) END AS epicName,
         ts AS statusCreated, event_type AS statusName,
         CASE WHEN value >= 2
              THEN 'a' || (CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) % 20) END AS statusAuthor,
         event_id AS pos
  FROM events)
"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per order line."""
    repo = F.col("l_suppkey")
    part = F.col("l_partkey")
    root = F.concat(F.lit("root"), (repo % 5).cast("string"))
    namespace = F.concat(root, F.lit(" / group"), (repo % 25).cast("string"))
    additions = F.col("l_quantity").cast("int")
    lines = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_shipdate") + F.make_dt_interval(hours=(part % 24).cast("int"))).alias("createdAt"),
        F.concat(namespace, F.lit(" / repo"), repo.cast("string")).alias("project"),
        namespace.alias("namespace"),
        F.concat(
            F.lit("dev"), part.cast("string"), F.when(part % 7 == 0, "@mail-x.example").otherwise("@corp.example")
        ).alias("committer"),
        additions.alias("additions"),
        (-lines).alias("deletions"),
        (additions + lines).alias("total"),
        (additions - lines).alias("effective"),
        repo.cast("int").alias("projectId"),
    )


COMMITS_SQL = """
commits AS (
  SELECT l_shipdate + (l_partkey % 24) * INTERVAL 1 HOUR AS createdAt,
         'root' || (l_suppkey % 5) || ' / group' || (l_suppkey % 25) || ' / repo' || l_suppkey AS project,
         'root' || (l_suppkey % 5) || ' / group' || (l_suppkey % 25) AS namespace,
         'root' || (l_suppkey % 5) AS rootNamespace,
         'dev' || l_partkey || CASE WHEN l_partkey % 7 = 0 THEN '@mail-x.example' ELSE '@corp.example' END AS committer,
         CAST(l_quantity AS INTEGER) AS additions, -l_linenumber AS deletions,
         CAST(l_quantity AS INTEGER) + l_linenumber AS total,
         CAST(l_suppkey AS INTEGER) AS projectId
  FROM lineitem)
"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    name = F.concat(F.lit("repo"), key.cast("string"))

    def numbered(prefix: str, modulus: int):
        return F.concat(F.lit(prefix), (key % modulus).cast("string"))

    return table(spark, sf_dir, "supplier").select(
        key.cast("int").alias("id"),
        name.alias("name"),
        F.concat_ws(" / ", numbered("root", 5), numbered("group", 25), name).alias("name_with_namespace"),
        F.array(numbered("role", 3), numbered("cat", 4), F.lit("noise")).alias("tag_list"),
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role vocabulary: the first two of three tags, so that some tags miss."""
    return table(spark, sf_dir, "region").where("r_regionkey < 2").select(
        F.concat(F.lit("role"), F.col("r_regionkey").cast("string")).alias("value")
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").where("r_regionkey < 3").select(
        F.concat(F.lit("cat"), F.col("r_regionkey").cast("string")).alias("value")
    )


PROJECTS_SQL = """
projects AS (
  SELECT CAST(s_suppkey AS INTEGER) AS id, 'repo' || s_suppkey AS name,
         'root' || (s_suppkey % 5) || ' / group' || (s_suppkey % 25) || ' / repo' || s_suppkey AS name_with_namespace,
         'root' || (s_suppkey % 5) AS rootNamespace,
         'root' || (s_suppkey % 5) || ' / group' || (s_suppkey % 25) AS namespace,
         'role' || (s_suppkey % 3) AS roleTag, 'cat' || (s_suppkey % 4) AS catTag
  FROM supplier),
project_roles AS (SELECT id, roleTag AS role FROM projects WHERE roleTag IN ('role0', 'role1')),
project_categories AS (SELECT id, catTag AS category FROM projects WHERE catTag IN ('cat0', 'cat1', 'cat2'))
"""


def merge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of merge requests: one per order line, the order being the request."""
    key = F.col("l_orderkey")
    created = F.lit("1998-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        days=(key % 1400).cast("int"), hours=(key % 24).cast("int")
    )
    flag = F.col("l_returnflag")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        created.alias("createdAt"),
        key.cast("int").alias("id"),
        F.col("l_suppkey").cast("int").alias("projectId"),
        F.concat(F.lit("u"), (key % 499).cast("string")).alias("author"),
        F.when(flag == "R", "merged").when(flag == "A", "closed").otherwise("opened").alias("state"),
        F.concat(F.lit("feature-"), (F.col("l_partkey") % 100).cast("string")).alias("sourceBranch"),
        F.when(F.col("l_linestatus") == "O", "develop").otherwise("master").alias("targetBranch"),
        F.col("l_linenumber").alias("userNotesCount"),
        F.when(
            flag == "R", created + F.make_dt_interval(days=F.col("l_quantity").cast("int"), hours=F.lit(5))
        ).alias("mergedAt"),
        (days.cast("long") * 86_400_000).alias("updatedAt"),
        F.col("l_partkey").alias("revision"),
    )


# Versions of equal time are told apart by these columns, so that one is newest.
NEWEST = ("userNotesCount", "revision", "projectId")

MERGE_REQUESTS_SQL = """
merge_requests AS (
  SELECT TIMESTAMP '1998-01-01' + (l_orderkey % 1400) * INTERVAL 1 DAY + (l_orderkey % 24) * INTERVAL 1 HOUR AS createdAt,
         CAST(l_orderkey AS INTEGER) AS id, CAST(l_suppkey AS INTEGER) AS projectId, 'u' || (l_orderkey % 499) AS author,
         CASE l_returnflag WHEN 'R' THEN 'merged' WHEN 'A' THEN 'closed' ELSE 'opened' END AS state,
         'feature-' || (l_partkey % 100) AS sourceBranch,
         CASE WHEN l_linestatus = 'O' THEN 'develop' ELSE 'master' END AS targetBranch,
         l_linenumber AS userNotesCount,
         CASE WHEN l_returnflag = 'R'
              THEN TIMESTAMP '1998-01-01' + (l_orderkey % 1400) * INTERVAL 1 DAY + (l_orderkey % 24 + 5) * INTERVAL 1 HOUR
                   + CAST(l_quantity AS INTEGER) * INTERVAL 1 DAY END AS mergedAt,
         epoch_ms(l_shipdate) AS updatedAt, l_partkey AS revision
  FROM lineitem),
latest AS (
  SELECT * FROM merge_requests
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updatedAt DESC, userNotesCount DESC, revision DESC, projectId DESC) = 1)
"""

SETTINGS = Settings(
    flows={
        "P0": FlowSpec(FLOW.reference_flow, "view", "purchase", estimate_mapping={"S": 3, "M": 5, "L": 8}),
        "P1": FlowSpec(FLOW.reference_flow, "view", "purchase", estimate_mapping={"S": 1, "M": 2}),
        "P2": FlowSpec(FLOW.reference_flow, "view", "purchase"),
    },
    email_mapping={"dev1@corp.example": "dev2@corp.example", "dev7@mail-x.example": "dev8@corp.example"},
    estimate_field="size_field",
    story_points_field="points_field",
    epic_name_field="epic_field",
)


def _offset_text(ts):
    text = ts.cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit(".000+0200"))


def issues(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, carried=()) -> DataFrame:
    """One issue per event, with a change log made of the event's own columns; columns of ``events`` may be carried along."""
    key, user, ts = F.col("event_id"), F.col("user_id"), F.col("ts")

    def person(prefix: str, modulus: int):
        name = F.concat(F.lit(prefix), (user % modulus).cast("string"))
        return F.struct(name.alias("accountId"), name.alias("displayName"))

    def item(field: str, text, to=None):
        return F.struct(
            F.lit(field).alias("fieldId"),
            F.lit(None).cast("string").alias("from"),
            F.lit(None).cast("string").alias("fromString"),
            (F.lit(None) if to is None else to).cast("string").alias("to"),
            text.cast("string").alias("toStr"),
        )

    def history(number: int, hours, author, *items):
        return F.struct(
            F.concat(key.cast("string"), F.lit(f"-{number}")).alias("id"),
            author.alias("author"),
            _offset_text(ts + F.make_dt_interval(hours=hours)).alias("created"),
            F.array(*items).alias("items"),
        )

    size = F.element_at(F.array(*[F.lit(name) for name in ("S", "M", "L", "XL")]), (key % 4 + 1).cast("int"))
    points = F.when(key % 3 == 0, "").when(key % 3 == 1, F.lit("2.5"))
    version = F.when(key % 6 == 0, "next").otherwise((key % 100).cast("string"))
    histories = F.array(
        history(1, F.lit(1), person("a", 5), item("status", F.lit("signup")), item("size_field", size)),
        history(
            2, (key % 3).cast("int"), person("b", 4), item("points_field", points), item("status", F.col("event_type"))
        ),
        history(
            3,
            F.lit(2),
            person("a", 5),
            item("fixVersions", version, version),
            item("epic_field", F.concat(F.lit("epic"), (user % 7).cast("string"))),
            item("size_field", F.when(key % 5 > 0, size)),
        ),
        history(4, F.lit(3), person("b", 4), item("assignee", F.col("event_type"))),
    )
    events = table(spark, sf_dir, "events") if events is None else events
    return events.select(
        *carried,
        F.concat(F.lit("P"), (user % 3).cast("string")).alias("project"),
        F.concat(F.lit("I-"), key.cast("string")).alias("key"),
        F.struct(
            F.concat(F.lit("event "), key.cast("string")).alias("summary"),
            F.when(F.col("event_type") == "purchase", _offset_text(ts + F.make_dt_interval(days=F.lit(3)))).alias(
                "resolutiondate"
            ),
            _offset_text(ts).alias("created"),
            F.struct((user % 2).cast("string").alias("id"), F.when(user % 2 == 0, "Story").otherwise("Bug").alias("name")).alias(
                "issuetype"
            ),
            person("u", 10).alias("reporter"),
            F.struct(F.when(user % 3 == 0, "Critical").otherwise("Low").alias("name")).alias("priority"),
        ).alias("fields"),
        F.struct(histories.alias("histories")).alias("changelog"),
    )


ISSUES_SQL = """
base AS (
  SELECT *, date_trunc('second', ts) AS t0, 'P' || (user_id % 3) AS project,
         ['S', 'M', 'L', 'XL'][CAST(event_id % 4 + 1 AS INTEGER)] AS size0,
         CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '2.5' END AS points0,
         CASE WHEN event_id % 6 = 0 THEN 'next' ELSE CAST(event_id % 100 AS VARCHAR) END AS version0,
         'a' || (user_id % 5) AS first_author, 'b' || (user_id % 4) AS second_author
  FROM events),
changes AS (
  SELECT event_id, t0 + INTERVAL 1 HOUR AS t, 0 AS pos, 'status' AS field, 'signup' AS text_, first_author AS author FROM base
  UNION ALL SELECT event_id, t0 + INTERVAL 1 HOUR, 1, 'size', size0, first_author FROM base
  UNION ALL SELECT event_id, t0 + (event_id % 3) * INTERVAL 1 HOUR, 2, 'points', points0, second_author FROM base
  UNION ALL SELECT event_id, t0 + (event_id % 3) * INTERVAL 1 HOUR, 3, 'status', event_type, second_author FROM base
  UNION ALL SELECT event_id, t0 + INTERVAL 2 HOUR, 4, 'version', version0, first_author FROM base
  UNION ALL SELECT event_id, t0 + INTERVAL 2 HOUR, 5, 'epic', 'epic' || (user_id % 7), first_author FROM base
  UNION ALL SELECT event_id, t0 + INTERVAL 2 HOUR, 6, 'size', CASE WHEN event_id % 5 > 0 THEN size0 END, first_author FROM base),
last_change AS (
  SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY event_id, field ORDER BY t DESC, pos DESC) = 1),
work_items AS (
  SELECT project, 'I-' || b.event_id AS id, 'event ' || b.event_id AS name,
         CASE WHEN user_id % 2 = 0 THEN 'Story' ELSE 'Bug' END AS "type",
         CASE WHEN user_id % 3 = 0 THEN 'Critical' ELSE 'Low' END AS priority, t0 AS created,
         CASE WHEN event_type = 'purchase' THEN t0 + INTERVAL 3 DAY END AS closed, 'u' || (user_id % 10) AS createdBy,
         s.text_ AS size,
         coalesce(CASE project WHEN 'P0' THEN CASE s.text_ WHEN 'S' THEN 3.0 WHEN 'M' THEN 5.0 WHEN 'L' THEN 8.0 END
                               WHEN 'P1' THEN CASE s.text_ WHEN 'S' THEN 1.0 WHEN 'M' THEN 2.0 END END::DOUBLE,
                  TRY_CAST(p.text_ AS DOUBLE), 0.0) AS estimate,
         e.text_ AS epicName, TRY_CAST(v.text_ AS INTEGER) AS version, b.event_id
  FROM base b JOIN last_change s ON s.event_id = b.event_id AND s.field = 'size'
  JOIN last_change p ON p.event_id = b.event_id AND p.field = 'points'
  JOIN last_change e ON e.event_id = b.event_id AND e.field = 'epic'
  JOIN last_change v ON v.event_id = b.event_id AND v.field = 'version')
"""


def raw_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed commits, one per order line; some by a bot."""
    part, lines, additions = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    number = F.concat_ws("-", "l_orderkey", lines, part, "l_suppkey", F.col("l_shipdate").cast("date"))
    email = F.when(part % 11 == 0, F.concat(F.lit("jenkins"), (part % 4).cast("string"))).otherwise(
        F.concat(
            F.lit("dev"), part.cast("string"), F.when(part % 7 == 0, "@mail-x.example").otherwise("@corp.example")
        )
    )
    return table(spark, sf_dir, "lineitem").select(
        number.alias("id"),
        F.substring(number, 1, 8).alias("short_id"),
        F.lit("title").alias("title"),
        F.lit("message").alias("message"),
        _offset_text(F.col("l_shipdate") + F.make_dt_interval(hours=(part % 24).cast("int"))).alias("created_at"),
        email.alias("committer_email"),
        F.struct(additions.alias("additions"), lines.alias("deletions"), (additions + lines).alias("total")).alias("stats"),
        F.col("l_suppkey").cast("int").alias("project_id"),
    )


RAW_COMMITS_SQL = """
raw_commits AS (
  SELECT l_shipdate + (l_partkey % 24 - 2) * INTERVAL 1 HOUR AS "time",
         'dev' || l_partkey || CASE WHEN l_partkey % 7 = 0 THEN '@mail-x.example' ELSE '@corp.example' END AS email,
         CAST(l_suppkey AS INTEGER) AS project_id, CAST(l_quantity AS INTEGER) AS added, l_linenumber AS removed
  FROM lineitem WHERE l_partkey % 11 <> 0)
"""


def raw_merge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed merge requests, one row per version."""
    requests = merge_requests(spark, sf_dir)

    def text(ts):
        return _offset_text(ts)

    updated = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        days=(F.col("updatedAt") / 86_400_000).cast("int")
    )
    return requests.select(
        "id",
        F.col("id").alias("iid"),
        "state",
        text(F.col("createdAt")).alias("created_at"),
        F.struct(F.col("id").alias("id"), F.col("author").alias("username")).alias("author"),
        text(F.col("mergedAt")).alias("merged_at"),
        F.lit(None).cast("string").alias("closed_at"),
        F.col("userNotesCount").alias("user_notes_count"),
        F.col("projectId").alias("project_id"),
        F.col("sourceBranch").alias("source_branch"),
        F.col("targetBranch").alias("target_branch"),
        text(updated).alias("updated_at"),
    )
