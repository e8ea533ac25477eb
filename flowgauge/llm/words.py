"""Words of Arrow text batches as numpy arrays: no Python object per word.

Words are runs of bytes other than space and 09-0D, found in the UTF-8 bytes of many texts at once. A word is known by a
64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values ^= values >> np.uint64(27)
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        table = np.full(size, base, np.uint64)
        table[0] = 1
        return np.multiply.accumulate(table)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


@dataclass
class Words:
    """Words of the texts ``first_row .. first_row + n_rows`` of a batch, in order."""

    first_row: int
    n_rows: int
    data: np.ndarray  # all bytes of these texts
    bounds: np.ndarray  # where each text starts in data, and the end
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    first: np.ndarray  # index of the first word of each text, and the number of words

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash per word; ``lower`` takes A-Z as a-z."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = 1 << max(20, int(len(self.data)).bit_length())
        powers, inverse = _powers(size)
        total = np.empty(len(self.data) + 1, np.uint64)
        total[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * powers[: len(self.data)], out=total[1:])
        return mixed((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def rows(self) -> np.ndarray:
        """For each word, the index of its text among these texts."""
        return np.repeat(np.arange(self.n_rows), np.diff(self.first))


def word_chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """All texts of a column (null: empty), in chunks of bounded bytes; a longer text is a chunk of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    everything = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, "right")) - 1
        end = min(n, max(row + 1, end))
        data = everything[offsets[row] : offsets[end]]
        bounds = offsets[row : end + 1] - offsets[row]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~_SPACES[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        yield Words(row, end - row, data, bounds, starts, ends, np.searchsorted(starts, bounds))
        row = end
