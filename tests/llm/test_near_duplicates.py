import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from flowgauge.llm import near_duplicates as nd
from flowgauge.llm.components import connected_components


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j, both in Counter(j for g in sets[i] for j in holders[g] if j < i).items():
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(10**6))
    return " ".join(words)


def check(spark, documents, rows):
    found = nd.near_duplicates(spark, documents(rows)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == brute(rows)
    return found


def test_same_as_brute_force(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_SETS", 8)  # components of several blocks
    rng = random.Random(5)
    rows = [(10 * i, prose(i, rng.randint(1, 60))) for i in range(60)]
    base = prose(99, 120)
    for i in range(60):  # one large group of near copies, some of them past the threshold
        rows.append((10 * i + 1, edited(base, rng, rng.randint(0, 6))))
    for i in range(30):
        rows.append((10 * i + 2, edited(rows[i][1], rng, rng.randint(0, 3))))
    passage = prose(7, 55)
    rows += [(10 * i + 3, prose(500 + i, 40) + " " + passage) for i in range(30)]  # a passage that many share
    rows += [(10 * i + 4, passage + " " + prose(600 + i, i % 9)) for i in range(20)]
    rng.shuffle(rows)
    check(spark, documents, rows)


def test_negative_ids(spark, documents, prose):
    rng = random.Random(11)
    texts = [prose(i, 60) for i in range(40)]
    rows = [(rng.getrandbits(64) - 2**63, t) for t in texts]
    rows += [(rng.getrandbits(64) - 2**63, edited(t, rng, rng.randint(0, 2))) for t in texts]
    rows += [(-1, texts[0] + " end"), (0, texts[1] + " end"), (-(2**63), texts[2] + " end")]
    # A row per batch, so that all hits are found between batches.
    for n in ("1", "500"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        check(spark, documents, rows)


def test_edge_cases(spark, documents, prose):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE\x0b"), (6, "a b c d"), (7, "A b\tc d"), (8, "a b c d e"), (8, "a b c d e"),
        (None, "a b c d e"), (None, None), (9, prose(1, 20000)), (10, prose(1, 20000) + " more"), (11, "é É"), (12, "é é"),
        (13, "x " * 30), (14, "x " * 31),
    ]
    found = check(spark, documents, rows)
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert nd.near_duplicates(spark, documents([])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_trie_walk(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 12 + seed * 5, rng.integers(1, 25))) for _ in range(80)]
    sizes = np.array([len(s) + rng.integers(0, 2) for s in sets])
    half = np.arange(40), np.arange(30, 80)
    found = sorted(nd.trie_links(sets, sizes, *half))
    want = [
        (a, p) for p in half[0] for a in half[1]
        if 7 * len(np.intersect1d(sets[a], sets[p])) >= 3 * (sizes[a] + sizes[p])
    ]
    assert found == sorted(want)


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7), (1, 0)]
    found = connected_components(spark, spark.createDataFrame(edges, "a long, b long"))
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.node: r.component for r in found.collect()} == {a: c for a, c in parent.items() if a != c}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
