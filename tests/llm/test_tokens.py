import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from flowgauge.llm import bpe, packing, token_counts
from tokenizers import Tokenizer, models, pre_tokenizers

ALPHABET = "abthein  éñ\n\t▁日🙂'sl0129.,!?-  \x1c"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_vocabulary())


def texts():
    rng = random.Random(4)
    made = ["".join(rng.choices(ALPHABET, k=rng.randrange(60))) for _ in range(800)]
    return [*made, "", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "x" * 30000, " " * 5000 + "a", "ab" * 9000, "\n" * 50]


def ids_of(encoder, text):
    return [at for part in encoder.stream(text) for at in part]


def test_bpe_same_as_library(library, vocabulary):
    encoder = bpe.Encoder(vocabulary)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(encoder, text) == want
        decoder = bpe.Decoder(vocabulary)
        got = "".join([decoder.feed([at]) for at in want]) + decoder.finish()
        assert got == library.decode(want, skip_special_tokens=False)


def test_lookahead_suffices(vocabulary):
    rng = random.Random(8)
    assert 0 < vocabulary.lookahead < 1000
    for _ in range(60):
        data = "".join(rng.choices(rng.choice(["ab", "aeinorst", "-=_", "hhe", "é日"]), k=3000)).encode()
        assert list(vocabulary.encode_word(data)) == vocabulary._merged(data)


def test_decoder_replaces_broken_bytes(library, vocabulary):
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(256) for _ in range(rng.randrange(12))]
        decoder = bpe.Decoder(vocabulary)
        assert "".join([decoder.feed([at]) for at in ids]) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_bpe_frames(spark, documents, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "é" * 5000)]
    found = bpe.decode(bpe.encode(documents(rows))).collect()
    assert [(r.ids, r.decoded) for r in found] == [(library.encode(t or "", add_special_tokens=False).ids, t or "") for _, t in rows]
    assert all(r.rep == "own" for r in found)
    digests = bpe.encode_and_decode(documents(rows)).collect()
    assert [r.n_tokens for r in digests] == [len(r.ids) for r in found]
    for r, (_, text) in zip(digests, rows):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_and_decode(documents([])).count() == 0


def test_words_side_by_side(vocabulary):
    rng = random.Random(5)
    words = ["".join(rng.choices(ALPHABET, k=rng.randrange(1, 20))).encode()[:64] for _ in range(3000)] + [bytes([b]) for b in range(256)]
    words += [b"aaaaaaaa", b" the" * 16, b"-" * 63, bytes(range(64))]
    assert vocabulary.merge_words(words) == [tuple(vocabulary._merged(word)) for word in words]
    assert vocabulary.merge_words([]) == []


def test_short_pattern_is_the_pattern():
    rng = random.Random(6)
    points = [chr(at) for at in range(0x10000) if not 0xD800 <= at < 0xE000]
    for _ in range(4):
        rng.shuffle(points)
        text = "".join(c + rng.choice(["", "", " ", "  ", "a", "1", "!", "'s", "\n "]) for c in points)
        assert bpe._pattern(text) is bpe._short_pattern()
        assert bpe._short_pattern().findall(text) == bpe.PATTERN.findall(text)
    assert bpe._pattern("a\U0001d400") is bpe.PATTERN


def test_worker_keeps_vocabulary_and_words(monkeypatch, prose, library):
    source = bpe.read_vocabulary()
    loaded, merged = [], []
    load, merge = bpe.Vocabulary.__init__, bpe.Vocabulary._merged
    monkeypatch.setattr(bpe.Vocabulary, "__init__", lambda self, source: (loaded.append(1), load(self, source))[1])
    monkeypatch.setattr(bpe.Vocabulary, "_merged", lambda self, data: (merged.append(data), merge(self, data))[1])
    texts = [prose(at, 200) for at in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], names=["doc_id", "text"])
    tasks = [[row for part in bpe._digests(source)(iter([batch])) for row in part.to_pylist()] for _ in range(3)]
    assert tasks[0] == tasks[1] == tasks[2] and [r["n_tokens"] for r in tasks[0]] == [len(library.encode(t).ids) for t in texts]
    assert len(loaded) <= 1 and not merged  # words are short, so they are merged side by side, and once


def test_few_words_kept(vocabulary, library, monkeypatch, prose):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 300)
    encoder = bpe.Encoder(vocabulary)
    made = [*texts(), *(prose(at % 30, 100) for at in range(90)), "🙂 " + prose(1, 30_000)]
    for start in range(0, len(made), 7):
        part = made[start : start + 7]
        for text, stream in zip(part, encoder.streams(part)):
            assert [at for ids in stream for at in ids] == library.encode(text, add_special_tokens=False).ids
    assert encoder.seen.older
    for at in range(40):
        list(encoder.stream(prose(at, 100)))
        assert len(encoder.seen) <= 300 and len(encoder.seen.older) <= 40_000


def test_counts_same_as_library():
    pieces = token_counts.read_pieces()
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.Counter(pieces)
    for text in [*texts(), "🙂" * 40, "a🙂🙂b🙂"]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:40]


def test_count_ties():
    pieces = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0)]
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.Counter(pieces)
    for text in ("ab", "abab", "a b", "aab bba", "xaby"):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_count_frames(spark, documents):
    rows = [(1, None), (2, ""), (3, " "), (4, "one two"), (4, "one two"), (None, "w" * 200_000)]
    found = token_counts.token_counts(documents(rows)).collect()
    assert [r.n_pieces for r in found][:2] == [0, 0] and found[3].n_pieces == found[4].n_pieces > 0
    assert token_counts.token_counts(documents([])).count() == 0


def best_fit(items, window):
    bins = []
    for item in sorted(items, reverse=True):
        fitting = [i for i, rest in enumerate(bins) if rest >= item]
        if not fitting:
            bins.append(window)
        chosen = min(fitting, key=lambda i: bins[i]) if fitting else len(bins) - 1
        bins[chosen] -= item
    return sorted(bins)


@pytest.mark.parametrize("window", [8, 50, 1024])
def test_plan_is_best_fit_decreasing(window):
    rng = random.Random(window)
    for _ in range(300):
        items = [rng.randint(1, max(1, window // rng.choice([1, 1, 3, 8]))) for _ in range(rng.randrange(80))]
        filled, counts = Counter(), Counter()
        for length, first, n, sequence, per_window, offset in packing.plan(Counter(items), window):
            assert first == counts[length]
            counts[length] += n
            for k in range(n):
                assert filled[sequence + k // per_window] == offset + k % per_window * length
                filled[sequence + k // per_window] += length
        assert counts == Counter(items) and sorted(filled) == list(range(len(filled)))
        assert sorted(window - used for used in filled.values()) == best_fit(items, window)


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 500_000 + "b", "\t \n" * 5000 + "x " * 100, " " * 4095 + "y", " " * 4096 + "<|endoftext|> z"])
def test_packing_takes_long_white_space(library, text):
    encode = packing._encoder(bpe.read_vocabulary())
    assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packed_documents(spark, documents, prose, library):
    rows = [(1, None), (2, ""), (3, "same"), (4, "same"), (4, "same"), (None, "no id"), (5, prose(1, 3000))]
    rows += [(10 + i, prose(i, 1 + 13 * i % 300)) for i in range(120)]
    found = packing.pack(spark, documents(rows)).collect()
    want = Counter()
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            piece = np.array(ids[at : at + 1024], "<u4")
            want[i, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want
    windows = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == windows.get(r.sequence_id, 0)
        windows[r.sequence_id] = r.offset + r.length
    assert max(windows.values()) <= 1024 and sorted(windows) == list(range(len(windows)))
    assert packing.pack(spark, documents([])).count() == 0
