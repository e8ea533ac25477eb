"""Byte-pair encoding as a streaming transducer with bounded lookahead, and an incremental decoder.

How far text to the right can change a token follows from the merge list (``sufficient_lookahead``). A long word is merged
in a window of fixed size; tokens that end that far before the end of the window cannot change any more and are emitted, and
the window moves on to the first token that can. Short words that a worker meets for the first time are merged side by side.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "byte_bpe_50k.json"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _form(letters: str, numbers: str) -> str:
    """The pattern of byte_bpe_50k.json with white space spelled out, as libraries differ in what \\s means."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


PATTERN = regex.compile(_form(r"\p{L}", r"\p{N}"))
WINDOW = 512
#: Words that a worker keeps twice (those met of late and those met before), the longest of them, and those merged side by side.
CACHED_WORDS, CACHED_BYTES, AT_ONCE = 400_000, 64, 2048
BATCH_WORDS = 1 << 16
_NONE = (1 << 62, -1)  # the rank of a pair that does not merge


@lru_cache(maxsize=1)
def _short_pattern() -> re.Pattern:
    """``PATTERN`` for texts without characters beyond U+FFFF, with its classes spelled out for the faster ``re``."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    letters, numbers = ("".join(f"{run[0]}-{run[-1]}" for run in regex.findall(rf"\p{{{kind}}}+", every)) for kind in "LN")
    return re.compile(_form(letters, numbers))


def _pattern(text: str) -> re.Pattern | regex.Pattern:
    return _short_pattern() if len(text.encode("utf-16-le")) == 2 * len(text) else PATTERN


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [at for at in range(256) if at not in set(plain)]
    return {chr(at): at for at in plain} | {chr(256 + n): at for n, at in enumerate(others)}


class Vocabulary:
    """Merges as (left id, right id) -> (rank, merged id), the bytes of every id, and the strings that are one token."""

    def __init__(self, source: bytes):
        read = json.loads(source)
        letters = _byte_letters()
        ids = read["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {
            at: bytes(letters[c] for c in token) for token, at in ids.items() if token not in self.special
        }
        self.bytes_of |= {at: token.encode() for token, at in self.special.items()}
        self.byte_ids = [ids[c] for c, _ in sorted(letters.items(), key=lambda item: item[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(read["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.lookahead = self.sufficient_lookahead()
        self.digits = {at: str(at) for at in self.bytes_of}
        keys = np.array([left << 32 | right for left, right in self.merges], np.int64)
        self._rank_of = np.argsort(keys).astype(np.int32)
        self._keys = keys[self._rank_of]
        self._merged_at = np.array([merged for _, merged in self.merges.values()], np.int32)
        self._numbers = np.array([*range(max(self.bytes_of) + 1)], object)  # words share these numbers

    def sufficient_lookahead(self) -> int:
        """Bytes after a token from which on no further text can change it.

        Text that follows can only change a token by merging with it from the right. Such changes run leftwards as a chain
        of merges of growing rank, where the right part of each starts with what the one before made or left standing. The
        longest total of left parts over all chains bounds the reach; ranks order the chains, so one pass finds it.
        """
        left_part: dict[int, int] = {}
        reach: dict[int, int] = {}  # by token: longest chain whose last merge made it or had it as left part
        longest = 0
        for (left, right), (_, merged) in self.merges.items():  # in order of rank
            before, token = 0, right
            while True:
                before = max(before, reach.get(token, 0))
                if token not in left_part:
                    break
                token = left_part[token]
            total = before + len(self.bytes_of[left])
            longest = max(longest, total)
            reach[left] = max(reach.get(left, 0), total)
            reach[merged] = max(reach.get(merged, 0), total)
            left_part.setdefault(merged, left)
        return longest

    def _merge_short(self, parts: list[int]) -> list[int]:
        merges = self.merges
        found = [merges.get(pair, _NONE) for pair in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best is _NONE:
                break
            merged, at = best[1], found.index(best)
            while at >= 0:  # leftmost first; only the pairs beside a merge change
                parts[at : at + 2] = [merged]
                del found[at]
                if at:
                    found[at - 1] = merges.get((parts[at - 1], merged), _NONE)
                if at < len(found):
                    found[at] = merges.get((merged, parts[at + 1]), _NONE)
                at = found.index(best, at) if best in found[at:] else -1
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same by a queue of merges over a linked list."""
        merges, n = self.merges, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(*found, at, parts[at], parts[at + 1]) for at in range(n - 1) if (found := merges.get((parts[at], parts[at + 1])))]
        queue = [(rank, at, merged, left, right) for rank, merged, at, left, right in queue]
        heapq.heapify(queue)
        while queue:
            _, at, merged, left, right = heapq.heappop(queue)
            other = after[at]
            if parts[at] != left or other < 0 or parts[other] != right:
                continue
            parts[at], parts[other] = merged, -1
            after[at] = after[other]
            if after[at] >= 0:
                before[after[at]] = at
            for a, b in ((before[at], at), (at, after[at])):
                if a >= 0 and b >= 0 and (found := merges.get((parts[a], parts[b]))):
                    heapq.heappush(queue, (found[0], a, found[1], parts[a], parts[b]))
        return [part for part in parts if part >= 0]

    def _merged(self, data: bytes) -> list[int]:
        parts = [self.byte_ids[b] for b in data]
        return self._merge_short(parts) if len(parts) <= 48 else self._merge_long(parts)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair; of pairs that do not merge, the number of merges."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._rank_of[at], np.int32(len(self._keys)))

    def merge_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of many short words, a row of an array to each. A step makes the first merge of least rank in every row.

        The cells of a row are a linked list, as in ``_merge_long``; the last one stays free and merges with nothing.
        """
        if not len(self._keys):
            return [tuple(self._merged(word)) for word in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width, none = int(lengths.max(initial=0)) + 1, len(self._keys)
        held = np.arange(width) < lengths[:, None]
        table = np.full((len(words), width), -1, np.int32)
        table[held] = np.array(self.byte_ids, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        open_ranks = np.full(table.shape, none, np.int32)
        open_ranks[:, :-1] = self._ranks(table[:, :-1], table[:, 1:])
        parts, ranks = table.reshape(-1), open_ranks.reshape(-1)
        after, before = np.arange(1, len(parts) + 1), np.arange(-1, len(parts) - 1)
        rows = np.arange(len(words))
        while len(rows):
            at = open_ranks[rows].argmin(1) + rows * width
            merging = ranks[at] < none
            rows, at = rows[merging], at[merging]
            other = after[at]
            parts[at], parts[other] = self._merged_at[ranks[at]], -1
            ranks[other] = none
            after[at] = after[other]
            before[after[at]] = at
            ranks[at] = self._ranks(parts[at], parts[after[at]])
            later = at[at > rows * width]
            ranks[before[later]] = self._ranks(parts[before[later]], parts[later])
        left = table >= 0
        ids = self._numbers[table[left]].tolist()
        ends = left.sum(1).cumsum().tolist()
        return [tuple(ids[start:end]) for start, end in zip([0, *ends], ends)]

    def encode_word(self, data: bytes) -> Iterator[int]:
        """Ids of one word; memory does not depend on its length."""
        start, window = 0, max(WINDOW, 4 * self.lookahead)
        while len(data) - start > window:
            stable = start + window - self.lookahead
            for token in self._merged(data[start : start + window]):
                if start + len(self.bytes_of[token]) > stable:
                    break
                start += len(self.bytes_of[token])
                yield token
        yield from self._merged(data[start:])


class _Seen(dict):
    """Ids of words met before, without long ones; asked for another word, it encodes that.

    When there are too many, words not met since the last time there were are forgotten.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.older: dict[str, tuple[int, ...]] = {}

    def learn(self, words: set[str]) -> None:
        """Merges the short ones of these words that were not met before."""
        new = [word for word in words if word not in self]
        if len(self) + len(new) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()
            new = words
        unknown = []
        for word in new:
            if found := self.older.get(word):
                self[word] = found
            elif len(data := word.encode()) <= CACHED_BYTES:
                unknown.append((word, data))
        unknown.sort(key=lambda pair: len(pair[1]))
        for start in range(0, len(unknown), AT_ONCE):
            block = unknown[start : start + AT_ONCE]
            self.update(zip((word for word, _ in block), self.vocabulary.merge_words([data for _, data in block])))

    def __missing__(self, word: str) -> Iterable[int]:
        return self.older.get(word) or self.vocabulary.encode_word(word.encode())


class Encoder:
    """Encodes texts as streams of ids, with a bounded memory of the words met before."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.seen = _Seen(vocabulary)
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def _words(self, text: str) -> Iterator[list[str] | int]:
        pieces = self.special.split(text) if self.special else [text]
        for at, piece in enumerate(pieces):
            if at % 2:
                yield self.vocabulary.special[piece]
            elif len(piece) < BATCH_WORDS:
                yield _pattern(piece).findall(piece)
            else:
                batch = []
                for m in _pattern(piece).finditer(piece):
                    batch.append(m.group())
                    if len(batch) >= BATCH_WORDS:
                        yield batch
                        batch = []
                yield batch

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of a text in order, in lists."""
        return next(self.streams([text]))

    def streams(self, texts: list[str]) -> Iterator[Iterator[list[int]]]:
        """The stream of every text; new words of texts that are not long are merged together."""
        cut = [[*self._words(text)] if len(text) < BATCH_WORDS else None for text in texts]
        self.seen.learn(set().union(*(words for found in cut if found for words in found if not isinstance(words, int))))
        for text, found in zip(texts, cut):
            yield self._ids(found) if found is not None else self._ids(self._learned(text))

    def _learned(self, text: str) -> Iterator[list[str] | int]:
        for words in self._words(text):
            if not isinstance(words, int):
                self.seen.learn(set(words))
            yield words

    def _ids(self, found: Iterable[list[str] | int]) -> Iterator[list[int]]:
        for words in found:
            yield [words] if isinstance(words, int) else list(chain.from_iterable(map(self.seen.__getitem__, words)))


class Decoder:
    """Ids to text: a byte-to-text state machine that holds the bytes of an unfinished character only."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def read_vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file, read on the driver and sent with the job (1.5 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=1)
def _encoder(source: bytes) -> Encoder:
    """A worker keeps it, with the words met, from task to task."""
    return Encoder(Vocabulary(source))


def _digests(source: bytes):
    def digest(vocabulary: Vocabulary, stream: Iterator[list[int]]) -> tuple[int, str, str]:
        decoder = Decoder(vocabulary)
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids in stream:
            if ids:
                ids_hash.update((("," if n else "") + ",".join(map(vocabulary.digits.__getitem__, ids))).encode())
                text_hash.update(decoder.feed(ids).encode())
                n += len(ids)
        text_hash.update(decoder.finish().encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            rows = [digest(encoder.vocabulary, stream) for stream in encoder.streams(texts)]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``ids``, the token ids of ``text`` (null: no tokens); a column ``ids`` is replaced."""
    source = read_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source)
        for batch in batches:
            texts = [text or "" for text in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            ids = [list(chain.from_iterable(stream)) for stream in encoder.streams(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])

    carried = docs.drop("ids")
    return carried.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried.schema) + "ids array<int>")


def decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``decoded``, the text of ``ids`` (null: empty); a column ``decoded`` is replaced."""
    source = read_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(source).vocabulary
        for batch in batches:
            texts = []
            for ids in batch.column(batch.schema.get_field_index("ids")).to_pylist():
                decoder = Decoder(vocabulary)
                texts.append(decoder.feed(ids or ()) + decoder.finish())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    carried = docs.drop("decoded")
    return carried.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried.schema) + "decoded string")


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    Null and empty texts have no tokens and the digests of empty strings; repeated rows get equal results; only ``doc_id``
    and ``text`` are read, so other columns cannot clash.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _digests(read_vocabulary(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
