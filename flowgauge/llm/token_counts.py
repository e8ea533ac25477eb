"""Count-only Viterbi: how many pieces a unigram tokenizer makes of a text, without making them.

An Aho-Corasick automaton finds all vocabulary matches in a word, and dynamic programming carries the best score and its
number of pieces to every place. Ties and unknown characters follow the rules of the unigram model in the tokenizers library:
a match replaces an earlier one only with a higher score, matches are tried by their start, a character that no piece covers
alone costs ten more than the worst piece, and neighbouring unknown characters are one piece. Text is cut before every run of
white space as that library's Metaspace step with ``split`` does.

Vocabulary and scores are read from a piece model file.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from math import inf

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS, CACHED_CHARS = 500_000, 48
BATCH_CHARS = 1 << 20
_WORD = re.compile(rf"[ {MARK}][^ {MARK}]*")


class _Seen(dict):
    """Counts of words met before, without long ones; asked for another word, it counts that."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(MARK + word[1:])
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


def read_pieces(path: str | None = None) -> list[tuple[str, float]]:
    """Ordinary pieces of a model file with their scores, in order of their ids."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (at for at in range(model.get_piece_size()) if not (model.is_control(at) or model.is_unknown(at) or model.is_byte(at)))
    return [(model.id_to_piece(at), float(model.get_score(at))) for at in ordinary]


class Counter:
    """Counts pieces of words, with a bounded memory of the words met before."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(piece) for piece, _ in pieces), default=1)
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.seen = _Seen(self.pieces_of)

    def pieces_of(self, word: str) -> int:
        """Number of pieces on the best path through a word.

        The state of a place is its best score, the number of pieces, and whether the last is an unknown one.
        """
        if len(word) <= CACHED_CHARS and self.single.issuperset(word):
            # Every character is a piece, so only matches count; those of one end come longest first.
            total, count = [0.0] + [-inf] * len(word), [0] * (len(word) + 1)
            for last, (size, score) in self.automaton.iter(word):
                reached = total[last + 1 - size] + score
                if reached > total[last + 1]:
                    total[last + 1], count[last + 1] = reached, count[last + 1 - size] + 1
            return count[-1]
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())
        match = next(matches, None)
        # Only places within the longest piece are looked at again.
        best: deque[tuple[float, int, bool]] = deque([(0.0, 0, False)], maxlen=self.longest + 1)
        for end, char in enumerate(word):
            state, ending = None, []
            while match is not None and match[0] == end:
                ending.append(match[1])
                match = next(matches, None)
            for size, score in ending:  # longest first: it starts earliest
                total, count, _ = best[-size]
                if state is None or total + score > state[0]:
                    state = (total + score, count + 1, False)
            if char not in self.single:
                total, count, unknown = best[-1]
                if state is None or total + self.unknown > state[0]:
                    state = (total + self.unknown, count + (not unknown), True)
            best.append(state)
        return best[-1][1]

    def count(self, text: str) -> int:
        """Number of pieces of a whole text; spaces count as the mark, and a text without one in front gets one."""
        if not text:
            return 0
        if text[0] not in (" ", MARK):
            text = MARK + text
        seen = self.seen.__getitem__
        if len(text) < BATCH_CHARS:
            return sum(map(seen, _WORD.findall(text)))
        return sum(seen(m.group()) for m in _WORD.finditer(text))


def _counts(pieces: list[tuple[str, float]]):
    made: list[Counter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Counter(pieces))
        for batch in batches:
            counts = [made[0].count(text or "") for text in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "n_pieces"])

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_pieces`` (long), the pieces of ``text``.

    A null or empty text has none; repeated rows get equal counts; a column ``n_pieces`` is replaced; the whole text is
    counted. The vocabulary (32,000 pieces) is read on the driver and sent with the job.
    """
    carried = docs.drop("n_pieces")
    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried.schema)
    return carried.mapInArrow(_counts(read_pieces(path)), f"{columns}n_pieces long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_pieces")
