import math
import re

import numpy as np
import pyarrow as pa
from flowgauge.llm import toxicity
from flowgauge.llm.toxicity import GRADES, SHARE, STEMS, Model, fit, fit_ordinal, score
from flowgauge.llm.words import word_chunks

INSULTS = ("grobnak", "vilzert", "trumok")


def corpus(prose, n, start=0):
    rows = []
    for i in range(n):
        toxic = int(i % 3 == 0)
        words = prose(start + i, 40 + i % 60).split()
        for k in range(toxic * (2 + i % 7)):
            words.insert((7 * k) % len(words), INSULTS[(i + k) % 3] + ("", "en", "a,", "ist")[k % 4])
        rows.append((start + i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy_and_order(spark, documents, prose):
    train, held = corpus(prose, 240), corpus(prose, 120, 10_000)
    labels = spark.createDataFrame([(i, t) for i, _, t in train], "doc_id long, toxic int")
    model = fit(documents([r[:2] for r in train]), labels)
    assert len(model.thresholds) == GRADES - 1 and list(model.thresholds) == sorted(model.thresholds)
    found = {r.doc_id: r for r in score(documents([r[:2] for r in held]), model).collect()}
    right = [found[i].toxic == bool(t) for i, _, t in held]
    assert np.mean(right) > 0.95
    toxic = [(text, found[i].severity) for i, text, t in held if t]
    shares = [sum(any(q in w for q in INSULTS) for w in text.split()) / len(text.split()) for text, _ in toxic]
    assert np.corrcoef(shares, [severity for _, severity in toxic])[0, 1] > 0.7


def test_gradient_finds_ordered_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    grade = np.digitize(x + 0.3 * rng.logistic(size=600), [-0.5, 0.5, 1.5])
    weights, thresholds = fit_ordinal(np.arange(600), np.zeros(600, int), x, grade, 1)
    assert weights[0] > 1.5 and np.all(np.diff(thresholds) > 0)
    chances = Model(np.zeros(0, np.uint64), np.zeros(0), thresholds).probabilities(weights[0] * x)
    assert np.allclose(chances.sum(axis=1), 1) and np.corrcoef(chances @ np.arange(4), grade)[0, 1] > 0.8


def test_edge_cases(spark, documents, prose):
    rows = [(1, None), (2, ""), (3, "  "), (4, "... !!"), (5, prose(1, 20000)), (5, prose(1, 20000)), (None, "w" * 100_000)]
    docs = documents(rows)
    for labels in ([], [(1, 1), (2, 0)], [(5, 1)], [(None, 1), (4, None)]):
        model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        found = score(docs, model).collect()
        assert len(found) == len(rows) and not any(r.toxic for r in found if not (r.text or "").strip())
        assert all(r.rep == "own" for r in found)
    assert score(documents([]), Model()).count() == 0


def test_sample_is_whole_and_only_used_features_reach_the_driver(spark, documents, prose, monkeypatch):
    assert toxicity.SAMPLE_PER_CLASS == 2500
    rows = corpus(prose, 120)
    docs = documents([r[:2] for r in rows])
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    brought = []
    real = toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda *a: brought.append(a) or real(*a))
    model = fit(docs, labels)
    # The same features by counting in one place.
    batch = docs.join(labels, "doc_id").select("toxic", "text").coalesce(1).toArrow().combine_chunks().to_batches()
    found = [
        (t, np.frombuffer(cell, np.uint64))
        for part in toxicity._sampled(iter(batch)) for t, cell in zip(part.column(0).to_pylist(), part.column(2).to_pylist())
    ]
    known, at = np.unique(np.concatenate([h for _, h in found]), return_inverse=True)
    kinds = np.repeat([t for t, _ in found], [len(h) for _, h in found])
    inside = [np.bincount(at[kinds == kind], minlength=len(known)) for kind in (0, 1)]
    odds = np.log((inside[1] + 0.5) / (sum(t for t, _ in found) + 1)) - np.log((inside[0] + 0.5) / (sum(not t for t, _ in found) + 1))
    want = known[(inside[0] + inside[1] >= toxicity.MIN_DOCS) & (known != 0) & (np.abs(odds) >= toxicity.MIN_LOG_ODDS)]
    assert model.hashes.tolist() == want.tolist() and len(want)
    row, column, _, grade = brought[0][:4]
    assert len(grade) == len(rows) and len(row) == sum(np.isin(h, want).sum() for _, h in found)
    assert sorted(set(column.tolist())) == list(range(len(want)))


def _hash_of(word):
    """Hash of a whole word by itself, and of its stems."""
    (words,) = word_chunks(pa.array([word]))
    return toxicity._features(words)[0][0]


def _walked(text, weight_of, thresholds):
    """Severity and verdict of a text, word by word."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    if not words:
        return 0.0, False
    total = 0.0
    for word in words:
        word = re.sub(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", b"", word)
        word = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        parts = [("word", word)] if word else []
        parts += [(stem, word[:stem]) for stem in STEMS if len(word) > stem]
        total += sum(weight_of.get(part, 0.0) for part in parts)
    score = SHARE * total / len(words)
    below = [1 / (1 + math.exp(-(t - score))) for t in thresholds] + [1.0]
    chances = [b - a for a, b in zip([0.0, *below], below)]
    return sum(grade * chance for grade, chance in enumerate(chances)), 1 - chances[0] >= 0.5


def test_scores_equal_a_walk_word_by_word(spark, documents, prose):
    # Features named by what they stand for: a whole word, or a stem of so many bytes.
    named = {("word", b"grobnak"): 1.5, (4, b"vilz"): 0.7, (6, b"trumok"): 2.0, ("word", b"a"): -0.2, (5, "\u00fcbler".encode()[:5]): 0.4}
    sources = {("word", b"grobnak"): "grobnak", (4, b"vilz"): "vilzert", (6, b"trumok"): "trumoken", ("word", b"a"): "a", (5, "\u00fcbler".encode()[:5]): "\u00fcblerer"}
    hashes = [_hash_of(sources[part])[0 if part[0] == "word" else 1 + STEMS.index(part[0])] for part in named]
    # A feature that shares its place in the look-up table with the strongest one must still be found, and change nothing else.
    rival = np.uint64(int(hashes[2]) ^ 1)
    order = np.argsort(np.array([*hashes, rival], np.uint64))
    weights = np.array([*named.values(), 9.0])[order]
    model = Model(np.array([*hashes, rival], np.uint64)[order], weights, np.array([1.0, 2.0, 3.5]))
    texts = [None, "", " \t ", "... !!", "Grobnak! (grobnak) GROBNAKS", "vilz vilze \"Vilzerei\"", "trumok trumoks", "a A a. b", "\u00fcbler \u00fcblers", "\u00a0a\u00a0 a"]
    texts += [" ".join((prose(i, 3 + i), "Trumoken,", "vilzert;", "grobnak" * (i % 3 > 0))) for i in range(60)]
    texts.append("grobnak " + "x" * 300_000)
    found = {r.doc_id: r for r in score(documents(list(enumerate(texts))), model).collect()}
    for at, text in enumerate(texts):
        severity, toxic = _walked(text, named, model.thresholds)
        assert math.isclose(found[at].severity, severity, abs_tol=1e-9), (text or "")[:60]
        assert found[at].toxic == toxic
    assert {r.toxic for r in found.values()} == {True, False}
