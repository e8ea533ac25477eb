import hashlib
import json
import zlib

import pytest
from flowgauge.llm.sharding import SHARDS, first_map, grow, load_map, rebalance, save_map, shard_documents
from flowgauge.session import scratch_path


def test_places_sizes_and_edge_cases(spark, documents, prose):
    texts = [None, "", "é", "same", "same"] + [prose(i, 5 + 37 * i % 200) for i in range(400)]
    rows = [*enumerate(texts), (3, "same"), (None, "no id")]
    found = shard_documents(spark, documents(rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in found) == sorted(
        (-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r)
    for part in by_shard.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = [sum(r.size for r in part) for part in by_shard.values()]
    assert len(sizes) == SHARDS and max(sizes) - min(sizes) <= max(r.size for r in found)
    assert len({r.virtual_slot for r in found if r.doc_id == 3}) == 1
    assert shard_documents(spark, documents([])).count() == 0


def test_versions_of_the_map(spark):
    path = scratch_path(spark, "map")
    save_map(first_map(spark, 64, 4), path)
    totals = spark.createDataFrame([(s, 100 if s < 16 else 10, 1) for s in range(64)], "virtual_slot int, bytes long, n_rows long")
    save_map(rebalance(load_map(spark, path), totals, 4), path)
    save_map(grow(load_map(spark, path), 4), path)
    old, new, grown = ({r.virtual_slot: r.shard for r in load_map(spark, path, v).collect()} for v in (0, 1, 2))
    assert old == {s: s // 16 for s in range(64)}
    loads = [sum(100 if s < 16 else 10 for s in new if new[s] == shard) for shard in range(4)]
    assert max(loads) - min(loads) <= 100
    assert all(new[s] == old[s] for s in range(16, 64)), "only slots beyond the fair share move"
    moved = [s for s in new if grown[s] != new[s]]
    assert moved and all(grown[s] == 4 for s in moved)
    assert load_map(spark, path).agg({"version": "max"}).first()[0] == 2


def test_a_stored_map_is_used_again(spark, documents):
    path, docs = scratch_path(spark, "map"), documents([(at, "x" * at) for at in range(50)])
    first = {r.doc_id: r.shard for r in shard_documents(spark, docs, path).collect()}
    second = {r.doc_id: r.shard for r in shard_documents(spark, docs, path).collect()}
    counts = {r["version"]: r["count"] for r in spark.read.parquet(path).groupBy("version").count().collect()}
    assert len(counts) == 3 and len(set(counts.values())) == 1 and sorted(counts) == [0, 1, 2]
    assert first.keys() == second.keys() and load_map(spark, path, 0).count() == counts[0]


def test_no_python_in_the_plan(spark, documents):
    plan = shard_documents(spark, documents([(1, "a")]).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n_shards", [1, 3])
def test_one_large_slot(spark, n_shards):
    totals = spark.createDataFrame([(5, 10**9, 1), (6, 1, 1)], "virtual_slot int, bytes long, n_rows long")
    found = {r.virtual_slot: r.shard for r in rebalance(first_map(spark, 8, n_shards), totals, n_shards).collect()}
    assert len(found) == 8 and (n_shards == 1 or found[5] != found[6])


def _walked(rows, n_slots=4096, n_shards=SHARDS):
    """Slot, shard and place of every record, one after the other: (doc_id, size, crc) -> (shard, slot)."""
    records = []
    for doc_id, text in rows:
        key = json.dumps({} if doc_id is None else {"doc_id": doc_id}, separators=(",", ":"))
        slot = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % n_slots
        body = (text or "").encode()
        records.append((slot, doc_id, len(body) + 1, zlib.crc32(body)))
    weight = dict.fromkeys(range(n_slots), 0)
    for slot, _, size, _ in records:
        weight[slot] += size
    owner = {slot: slot * n_shards // n_slots for slot in weight}
    fair = -(-sum(weight.values()) // n_shards)
    loads, moving = [0] * n_shards, []
    for shard in range(n_shards):
        running = 0
        for slot in sorted((s for s in owner if owner[s] == shard), key=lambda s: (-weight[s], s)):
            running += weight[slot]
            if running <= fair:
                loads[shard] += weight[slot]
            else:
                moving.append(slot)
    for slot in sorted(moving, key=lambda s: (-weight[s], s)):
        owner[slot] = loads.index(min(loads))
        loads[owner[slot]] += weight[slot]
    placed, taken = {}, [0] * n_shards
    for slot, doc_id, size, crc in sorted(records, key=lambda r: (r[0], r[1] is not None, r[1] or 0, *r[2:])):
        placed.setdefault((doc_id, size, crc), []).append((owner[slot], taken[owner[slot]]))
        taken[owner[slot]] += 1
    return placed


def test_equal_to_a_walk_over_all_records(spark, documents, prose):
    texts = [prose(i, 3 + 53 * i % 300) for i in range(700)]
    rows = [*enumerate(texts), *((-i, f"negative {i}") for i in range(1, 60)), (5, "again"), (5, "again"), (None, None), (7, "w" * 50_000)]
    want = _walked(rows)
    got = {}
    for r in shard_documents(spark, documents(rows)).collect():
        got.setdefault((r.doc_id, r.size, r.text_crc32), []).append((r.shard, r.slot))
    assert {key: sorted(places) for key, places in got.items()} == {key: sorted(places) for key, places in want.items()}
