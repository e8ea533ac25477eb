"""Flow normalization: from status histories to entry and final times.

A history, ordered by time and stripped of states outside the flow, is walked
from "not started" over "entered" to "finished":

* the entry state starts an item, or reopens a finished one under its first
  entry time;
* the final state finishes a started item;
* a state ranked below the entry state sends the item back to "not started";
* any state but the entry one directly after a final state does so too.

The last rule looks only at the preceding row: the final state is either just
entered, and the next state undoes it, or had no effect, and neither has the
next. So the rows that send an item back are known from the row and the one
before it, and the result needs no walk at all:

* entry time = first entry after the last such row (none: item not started);
* final time = the last row, if it is the final state and not such a row.

For nested items this is computed within the row. For flat rows the history of
one item may be arbitrarily long, so all rows are put in order of item, time and
place by ranges and cut into blocks; what a block holds of an item is reduced to one
row, the effect of that part of the history on any state before it, and only those
rows meet, one for each 4,096 changes. An item of a third of all rows is spread over
a third of the ranges, even if all its changes have the same time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from flowgauge.functions.time import time_span
from flowgauge.settings import FlowSpec

ENTRY, FINAL, BELOW, OTHER = 0, 1, 2, 3

# Rows of a block, as a power of two: what one group holds of an item at most.
BLOCK_BITS = 12


def state_kinds(spec: FlowSpec) -> dict[str, int]:
    """Role of every raw state name; names outside the flow are missing."""
    entry_rank = spec.reference_flow[spec.entry_state]
    kinds = {}
    for raw in {**spec.reference_flow, **spec.state_mapping}:
        name = spec.state_mapping.get(raw, raw)
        if name not in spec.reference_flow:
            continue
        if name == spec.entry_state:
            kinds[raw] = ENTRY
        elif name == spec.final_state:
            kinds[raw] = FINAL
        else:
            kinds[raw] = BELOW if spec.reference_flow[name] < entry_rank else OTHER
    return kinds


def _literal_map(values: Mapping[str, int]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def kinds_of(spec: FlowSpec | Mapping[str, FlowSpec], project: str = "project") -> Column:
    """Map from raw state name to kind, for each row that of its project if there is a spec for each.

    The specs come from the driver's config, so the map is as small as that file. A
    row of a project that has no spec fails the job.
    """
    if isinstance(spec, FlowSpec):
        return _literal_map(state_kinds(spec))
    by_project = F.create_map(*[part for key, flow in spec.items() for part in (F.lit(key), _literal_map(state_kinds(flow)))])
    missing = F.raise_error(F.concat(F.lit("no flow for project "), F.coalesce(F.col(project), F.lit("null"))))
    return F.coalesce(F.try_element_at(by_project, F.col(project)), missing.cast("map<string,int>"))


def with_state_kind(
    statuses: DataFrame, spec: FlowSpec | Mapping[str, FlowSpec], project: str = "project"
) -> DataFrame:
    """Add the column ``kind`` and drop rows outside the flow, of which there may be one per project."""
    kind = F.try_element_at(kinds_of(spec, project), F.col("statusName"))
    return statuses.withColumn("kind", kind).where(F.col("kind").isNotNull())


def _goes_back(kind: Column, before: Column) -> Column:
    return (kind == BELOW) | ((kind != ENTRY) & F.coalesce(before == FINAL, F.lit(False)))


def _is_timed_entry(status: Column) -> Column:
    return (status["kind"] == ENTRY) & status["created"].isNotNull()


def normalize_items(
    items: DataFrame, spec: FlowSpec | Mapping[str, FlowSpec], history: str = "statusHistory", project: str = "project"
) -> DataFrame:
    """Nested items with ``entry_at`` and ``final_at`` for their history, started ones only.

    ``history`` is an array of structs with ``created`` and ``name``; changes of
    equal time keep their place in the array. Row-local: nothing is shuffled.
    """
    kinds = kinds_of(spec, project)
    known = F.filter(
        F.transform(
            history,
            lambda status, at: F.struct(
                status["created"].alias("created"), at.alias("at"), F.try_element_at(kinds, status["name"]).alias("kind")
            ),
        ),
        lambda status: status["kind"].isNotNull(),
    )

    def place_if_back(status: Column, at: Column) -> Column:
        before = F.get("_ordered", at - 1)["kind"]
        return F.when(_goes_back(status["kind"], before), at).otherwise(-1)

    last_back = F.coalesce(F.array_max(F.transform("_ordered", place_if_back)), F.lit(-1))
    # slice() counts from one: the row after `last_back` is number `last_back + 2`.
    rest = F.slice("_ordered", last_back + 2, F.size("_ordered"))
    last = F.try_element_at("_rest", F.lit(-1))
    return (
        items.withColumn("_ordered", F.array_sort(known))
        .withColumn("_rest", rest)
        .withColumn("entry_at", F.get(F.filter("_rest", _is_timed_entry), F.lit(0))["created"])
        .where(F.col("entry_at").isNotNull())
        .withColumn("final_at", F.when(last["kind"] == FINAL, last["created"]))
        .drop("_ordered", "_rest", history)
    )


def normalize_statuses(
    statuses: DataFrame,
    spec: FlowSpec | Mapping[str, FlowSpec],
    keys: Sequence[str] = ("id",),
    attributes: Sequence[str] = (),
    project: str = "project",
    span_minutes: int | None = None,
) -> DataFrame:
    """The same for flat rows: ``keys + attributes + entry_at, final_at``.

    ``attributes`` are item columns, equal on all rows of an item. The same steps are
    taken for every length of history. Spark samples the input to find the ranges;
    ``span_minutes`` cuts histories into spans of time instead, which reads the input
    once, but then one task sees all changes of an item within a span.
    """
    known = with_state_kind(statuses, spec, project).select(
        *keys, *attributes, "kind", "pos", F.col("statusCreated").alias("ts")
    )
    if span_minutes is None:
        # Rows are numbered in their order, so a block of numbers takes the place of a span of time.
        ordered = known.repartitionByRange(*keys, "ts", "pos").sortWithinPartitions(*keys, "ts", "pos")
        cut = ordered.withColumn("span", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    else:
        cut = known.withColumn("span", time_span("ts", span_minutes))
    return _link_spans(_reduce_spans(cut, keys, attributes), keys, attributes)


def _with_running_count(rows: DataFrame, flag: str, window: WindowSpec, running: str, total: str) -> DataFrame:
    return rows.withColumns(
        {
            running: F.sum(flag).over(window.rowsBetween(Window.unboundedPreceding, 0)),
            total: F.sum(flag).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )


def _mark(rows: DataFrame, within: Sequence[str]) -> DataFrame:
    """Per row: the kinds around it, whether it sends back, and how many rows did so far and in all."""
    in_order = Window.partitionBy(*within).orderBy("ts", "pos")
    marked = rows.withColumns(
        {"before": F.lag("kind").over(in_order), "after": F.lead("kind").over(in_order)}
    ).withColumn("back", _goes_back(F.col("kind"), F.col("before")).cast("int"))
    return _with_running_count(marked, "back", in_order, "backs", "all_backs")


def _first_entry() -> Column:
    return F.min(F.when((F.col("kind") == ENTRY) & (F.col("backs") == F.col("all_backs")), F.col("ts")))


def _reduce_spans(rows: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row per item and span."""
    marked = _mark(rows, (*keys, "span"))
    is_first, is_last = F.col("before").isNull(), F.col("after").isNull()
    return marked.groupBy(*keys, *attributes, "span").agg(
        F.max(F.when(is_first, (F.col("kind") != ENTRY).cast("int"))).alias("opens_not_entry"),
        F.max("all_backs").alias("backs"),
        _first_entry().alias("entry"),
        F.max(F.when(is_last, F.col("kind"))).alias("last_kind"),
        F.max(F.when(is_last, F.col("back"))).alias("last_back"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("rows"),
    )


def _link_spans(spans: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Join up the spans of an item; one may begin with a row that the span before it makes one to send back."""
    over_spans = Window.partitionBy(*keys).orderBy("span")
    back_at_start = (F.col("opens_not_entry") == 1) & (F.col("kind_before") == FINAL)
    linked = (
        spans.withColumns(
            {"kind_before": F.lag("last_kind").over(over_spans), "next_span": F.lead("span").over(over_spans)}
        )
        .withColumn("back_at_start", F.coalesce(back_at_start, F.lit(False)))
        .withColumn("has_back", (F.col("back_at_start") | (F.col("backs") > 0)).cast("int"))
    )
    ends_final = (
        F.col("next_span").isNull()
        & (F.col("last_kind") == FINAL)
        & (F.col("last_back") == 0)
        & ~(F.col("back_at_start") & (F.col("rows") == 1))
    )
    return (
        _with_running_count(linked, "has_back", over_spans, "seen", "all_seen")
        .groupBy(*keys, *attributes)
        .agg(
            F.min(F.when(F.col("seen") == F.col("all_seen"), F.col("entry"))).alias("entry_at"),
            F.max(F.when(ends_final, F.col("last_ts"))).alias("final_at"),
        )
        .where(F.col("entry_at").isNotNull())
    )


def flow_steps(normalized: DataFrame, spec: FlowSpec) -> DataFrame:
    """Normalized histories as rows: ``status`` and ``created`` replace the two times."""
    steps = F.array(
        F.struct(F.lit(spec.entry_state).alias("status"), F.col("entry_at").alias("at")),
        F.struct(F.lit(spec.final_state).alias("status"), F.col("final_at").alias("at")),
    )
    keep = [name for name in normalized.columns if name not in ("entry_at", "final_at", "created")]
    return (
        normalized.select(*keep, F.inline(steps).alias("status", "created")).where(F.col("created").isNotNull())
    )
