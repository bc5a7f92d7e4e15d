"""Words of Arrow text columns, found and hashed without a Python object per word.

A word is a maximal run of bytes other than blank and 0x09-0x0D. No byte of a longer UTF-8
sequence has one of these values, so byte runs and character runs are the same words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


class Words(NamedTuple):
    """Words of a run of texts; ``first[d] : first[d + 1]`` are the words of text ``d``."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the text borders in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    if len(column) == 0 or borders[-1] == borders[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[borders[0]: borders[-1]]
    return data, borders - borders[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    _, borders = text_bytes(batch.column(batch.schema.get_field_index(text)))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(borders, borders[begin] + size, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
    pa.default_memory_pool().release_unused()  # workers live on after a task


def split(data: np.ndarray, borders: np.ndarray) -> Words:
    """All words of the texts ``data[borders[d] : borders[d + 1]]``."""
    n_docs = len(borders) - 1
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(n_docs + 1, np.int64))
    solid = ~_BLANK[data]
    inner = borders[:-1][borders[:-1] < len(data)]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    opens[inner] = solid[inner]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    before = borders[1:][borders[1:] > 0] - 1
    closes[before] = solid[before]
    begin = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(begin, borders)
    return Words(data, begin, end, np.repeat(np.arange(n_docs), np.diff(first)), first)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = -(-n // (1 << 18)) << 18
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
        _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, back)]))
    return _powers, _inverse


def hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the 64-bit hash of each byte run ``begin : end``; equal runs have equal hashes."""
    powers, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])

    def of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))

    return of


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run, all at once."""
    return hasher(data)(begin, end)


def windows(word_hash: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive words of one document, and where each begins."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _BASE + word_hash[j: j + n]
    return mix(total[at]), at
