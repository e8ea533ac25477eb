import random
from datetime import datetime, timedelta

import pytest
from flowgauge.operators import flow
from flowgauge.settings import FlowSpec

SPEC = FlowSpec(
    reference_flow={"backlog": 0, "todo": 1, "progress": 2, "review": 3, "testing": 4, "done": 5},
    entry_state="todo",
    final_state="done",
    state_mapping={"invalid": "done"},
)
START = datetime(2020, 1, 1)

CASES = [
    ("todo done", 1, 2),
    ("todo progress done", 1, 3),
    ("todo progress review progress done", 1, 5),
    ("todo progress review todo progress testing done", 1, 7),
    ("todo progress testing progress testing done", 1, 6),
    ("todo invalid", 1, 2),
    ("backlog todo progress backlog", None, None),
    ("backlog todo done", 2, 3),
    ("todo done todo done", 1, 4),
    ("todo done done", None, None),
    ("todo done done todo", 4, None),
    ("todo unknown done", 1, 3),
    ("done", None, None),
    ("progress done todo", 3, None),
    ("todo done review todo", 4, None),
    ("unknown", None, None),
]


def history(states):
    return [(START + timedelta(hours=hour), name) for hour, name in enumerate(states, 1)]


def nested(spark, histories):
    data = [(str(at), [(when, name, "someone") for when, name in items]) for at, items in enumerate(histories)]
    return spark.createDataFrame(
        data, "id string, statusHistory array<struct<created: timestamp_ntz, name: string, author: string>>"
    )


def flat(spark, histories):
    data = [
        (str(at), when, name, pos) for at, items in enumerate(histories) for pos, (when, name) in enumerate(items)
    ]
    return spark.createDataFrame(data, "id string, statusCreated timestamp_ntz, statusName string, pos long")


def as_dict(df):
    return {row["id"]: (row["entry_at"], row["final_at"]) for row in df.select("id", "entry_at", "final_at").collect()}


def expected(cases):
    def at(hour):
        return None if hour is None else START + timedelta(hours=hour)

    return {str(n): (at(entry), at(final)) for n, (_, entry, final) in enumerate(cases) if entry is not None}


def test_cases_nested(spark):
    histories = [history(states.split()) for states, _, _ in CASES]
    assert as_dict(flow.normalize_items(nested(spark, histories), SPEC)) == expected(CASES)


@pytest.mark.parametrize("minutes", [None, 1, 60, 24 * 60])
def test_cases_flat(spark, minutes):
    histories = [history(states.split()) for states, _, _ in CASES]
    assert as_dict(flow.normalize_statuses(flat(spark, histories), SPEC, span_minutes=minutes)) == expected(CASES)


def walk(items):
    """The rules, step by step."""
    entry = final = None
    for when, name in items:
        name = SPEC.state_mapping.get(name, name)
        if name not in SPEC.reference_flow:
            continue
        if entry is None:
            entry = when if name == SPEC.entry_state else None
        elif final is not None:
            entry, final = (entry, None) if name == SPEC.entry_state else (None, None)
        elif name == SPEC.final_state:
            final = when
        elif SPEC.reference_flow[name] < SPEC.reference_flow[SPEC.entry_state]:
            entry = None
    return entry, final


@pytest.fixture(scope="module")
def random_histories():
    chance = random.Random(7)
    states = ["backlog", "todo", "progress", "review", "done", "invalid", "elsewhere"]
    histories = []
    for _ in range(300):
        when, items = START, []
        for _ in range(chance.randint(1, 25)):
            # Many equal times: order in the document decides.
            when += timedelta(minutes=chance.choice([0, 0, 7, 45, 600]))
            items.append((when, chance.choice(states)))
        histories.append(items)
    return histories


def of_walk(histories):
    walked = {str(at): walk(items) for at, items in enumerate(histories)}
    return {key: value for key, value in walked.items() if value[0] is not None}


def test_random_histories_nested(spark, random_histories):
    assert as_dict(flow.normalize_items(nested(spark, random_histories), SPEC)) == of_walk(random_histories)


@pytest.mark.parametrize("minutes", [None, 1, 60, 100_000])
def test_random_histories_flat(spark, random_histories, minutes):
    shuffled = flat(spark, random_histories).orderBy("statusName")
    found = as_dict(flow.normalize_statuses(shuffled, SPEC, span_minutes=minutes))
    assert found == of_walk(random_histories)


def test_document_order_is_not_time_order(spark):
    late_first = [(START + timedelta(hours=2), "done"), (START + timedelta(hours=1), "todo")]
    found = as_dict(flow.normalize_items(nested(spark, [late_first]), SPEC))
    assert found == {"0": (START + timedelta(hours=1), START + timedelta(hours=2))}


def test_one_long_history(spark):
    states = ["todo", "progress", "done", "todo"] * 2000 + ["done"]
    items = [(START + timedelta(minutes=minute), name) for minute, name in enumerate(states)]
    for minutes in (None, 1, 10**6):
        found = as_dict(flow.normalize_statuses(flat(spark, [items]), SPEC, span_minutes=minutes))
        assert found == {"0": walk(items)}


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_histories_cut_anywhere(spark, random_histories, monkeypatch, bits):
    """Ranges end in the middle of histories, between changes of one time too."""
    monkeypatch.setattr(flow, "BLOCK_BITS", bits)
    rows = flat(spark, random_histories)
    try:
        for ranges in (2, 50):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert as_dict(flow.normalize_statuses(rows, SPEC)) == of_walk(random_histories), ranges
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_all_changes_at_one_time(spark):
    chance = random.Random(3)
    items = [(START, chance.choice(["backlog", "todo", "progress", "review", "done"])) for _ in range(5000)] + [(START, "todo"), (START, "done")]
    assert as_dict(flow.normalize_statuses(flat(spark, [items]).repartition(6), SPEC)) == {"0": walk(items)}


def test_flow_per_project(spark):
    rows = flat(spark, [history(["todo", "review"]), history(["todo", "review"])]).selectExpr("concat('p', id) AS project", "*")
    specs = {"p0": SPEC, "p1": SPEC.between(final_state="review")}
    found = flow.normalize_statuses(rows, specs, ("project", "id"))
    assert {row["project"]: row["final_at"] is not None for row in found.collect()} == {"p0": False, "p1": True}


def test_steps(spark, rows):
    normalized = flow.normalize_items(nested(spark, [history(["todo", "done"]), history(["todo"])]), SPEC)
    found = rows(flow.flow_steps(normalized, SPEC), "id", "status", "created")
    one, two = START + timedelta(hours=1), START + timedelta(hours=2)
    assert found == [("0", "done", two), ("0", "todo", one), ("1", "todo", one)]


def test_spec_is_checked():
    with pytest.raises(ValueError):
        SPEC.between(final_state="todo")
    with pytest.raises(ValueError):
        SPEC.between(final_state="nowhere")
