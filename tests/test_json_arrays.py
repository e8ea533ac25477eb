import json
import random

import pytest
from flowgauge.sources.issues import ARRAY, LINES, SPLIT, read_json

SCHEMA = "id LONG, text STRING, parts ARRAY<STRUCT<a: STRING, b: STRUCT<c: LONG>>>"


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def records(n, seed):
    rng = random.Random(seed)
    marks = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "語", "a", " ", '\\"', '"}', "},{", '{"id": 1}', "]\n"]

    def text():
        return "".join(rng.choices(marks, k=rng.choice((0, 1, 5, 20, 400 if rng.random() < 0.05 else 8))))

    return [
        {"id": i, "text": text(), "parts": [{"a": text(), "b": {"c": rng.randrange(9)} if rng.random() < 0.7 else None} for _ in range(rng.randrange(4))]}
        for i in range(n)
    ]


def plain(rows):
    return sorted((r.id, r.text, tuple((p.a, p.b.c if p.b else None) for p in r.parts or ())) for r in rows)


@pytest.mark.parametrize("indent", [None, 2, "\t"])
def test_split_arrays_equal_whole_ones_and_lines(spark, tmp_path, small_blocks, indent):
    folder, lines = tmp_path / "arrays", tmp_path / "lines"
    folder.mkdir(), lines.mkdir()
    for seed, n in enumerate((300, 1, 0, 40)):
        rows = records(n, seed)
        (folder / f"part-{seed}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=seed % 2 == 0), newline="\r\n" if indent else "")
        (lines / f"part-{seed}.json").write_text("\n".join(json.dumps(row) for row in rows))
    (folder / "none.json").write_text("")
    found = read_json(spark, str(folder), SCHEMA, SPLIT)
    assert plain(found.collect()) == plain(read_json(spark, str(lines), SCHEMA, LINES).collect())
    assert plain(found.collect()) == plain(read_json(spark, str(folder), SCHEMA, ARRAY).collect())
    assert spark.read.option("lineSep", "}").text(str(folder / "part-0.json")).rdd.getNumPartitions() > 20


def test_a_record_of_many_blocks(spark, tmp_path, small_blocks):
    rows = records(2, 1) + [{"id": 7, "text": '"}{[' * 5000, "parts": []}, {"id": 8, "text": "", "parts": [{"a": "x", "b": {"c": 1}}] * 400}]
    (tmp_path / "a.json").write_text(json.dumps(rows * 2))
    assert plain(read_json(spark, str(tmp_path), SCHEMA, SPLIT).collect()) == plain(read_json(spark, str(tmp_path), SCHEMA, ARRAY).collect())


@pytest.mark.parametrize("text", ['[{"id": 1}', '[{"id": 1}, 2]', '[{"id": 1} {"id": 2}]', '{"id": 1}', "[1]", '[{"id": }]', '[{"id": 1}]]', '[{"id": 1}, {"text": "'])
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        read_json(spark, str(tmp_path), SCHEMA, SPLIT).collect()


def test_split_arrays_are_not_shuffled(spark, tmp_path, small_blocks):
    """Only block summaries and the pieces at the ends of blocks meet; records within a block go straight to the parser."""
    (tmp_path / "a.json").write_text(json.dumps(records(300, 5)))
    plan = read_json(spark, str(tmp_path), SCHEMA, SPLIT)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and all(key.startswith("_file#") and "_block#" not in key for key in keys), keys


@pytest.mark.parametrize("layout", [ARRAY, SPLIT])
def test_many_tasks_read_one_array(spark, tmp_path, small_blocks, layout):
    rows = records(300, 6)
    (tmp_path / "a.json").write_text(json.dumps(rows))
    found = read_json(spark, str(tmp_path), SCHEMA, layout)
    assert found.rdd.getNumPartitions() > 20
    assert sorted(r.id for r in found.collect()) == [row["id"] for row in rows]


def test_array_layout_takes_files_of_one_object(spark, tmp_path, small_blocks):
    texts = ['﻿ {"id": 1, "text": "{[\\""}\n', '{"id": 2, "parts": [{"a": "}", "b": {"c": 1}}]}', "", " ", "[]", "\n[ ]", '[{"id": 3}]']
    for at, text in enumerate(texts):
        (tmp_path / f"{at}.json").write_text(text)
    assert sorted(r.id for r in read_json(spark, str(tmp_path), SCHEMA, ARRAY).collect()) == [1, 2, 3]


@pytest.mark.parametrize("text", ['{"id": 1', '{"id": 1, "text": "}', '[{"id": 1}], {"id": 2}]', '[{"id": 1}]{"a":[}]', '[{"id": 1},]', '[{"id": 1} , ', "["])
def test_broken_arrays_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        read_json(spark, str(tmp_path), SCHEMA, ARRAY).collect()
