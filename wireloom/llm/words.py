"""Words of many texts at once, in numpy and Arrow: no Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The six characters that divide words.
BLANKS = (9, 10, 11, 12, 13, 32)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[list(BLANKS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes of terms as they are, A-Z in lower case; what divides terms (ASCII but digits and letters) as a blank.
TERM = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    TERM[_low:_high] = LOWER[_low:_high]


class Words(NamedTuple):
    data: np.ndarray  # the words' bytes, each word followed by one blank
    ends: np.ndarray  # where each word's blank ends in data
    first: np.ndarray  # the first word of each text, and the number of words

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's place in the array of distinct words, which keep their blank."""
        coded = pa.Array.from_buffers(pa.large_binary(), len(self.ends), [None, pa.py_buffer(offsets(self.ends)), pa.py_buffer(self.data)]).dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary


def offsets(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), ends])


def binary(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins and the last ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    where = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[where[0] : where[-1]]
    return data, where - where[0]


def words(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """The words of each text; lower: with A-Z in lower case."""
    data, where = binary(texts)
    n = len(data)
    inside = ~IS_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[where] = True
    begins, stops = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | edge[1:n]
        stops[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    ends = np.cumsum(np.flatnonzero(stops) + 2 - starts)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    place = np.ones(len(out), bool)
    place[ends - 1] = False
    out[place] = data[inside]
    return Words(LOWER[out] if lower else out, ends, np.searchsorted(starts, where))


def terms(texts: pa.Array | pa.ChunkedArray) -> Words:
    """The terms of each text: runs of digits, letters and anything beyond ASCII, with A-Z in lower case."""
    data, where = binary(texts)
    cut = pa.Array.from_buffers(pa.large_binary(), len(where) - 1, [None, pa.py_buffer(np.ascontiguousarray(where)), pa.py_buffer(TERM[data])])
    return words(cut)


def hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))


#: Odd multipliers of the parts of a run of words, from the fractional parts of multiples of the golden ratio.
FACTORS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits depend on all bits, as published for splittable generators."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of so many consecutive values, wherever texts end."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = values[:n] * FACTORS[0]
    for j in range(1, width):
        total = total + mixed(values[j : j + n] ^ FACTORS[j]) * FACTORS[j]
    return mixed(total)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each of the lengths, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


@lru_cache(maxsize=1)
def _trim():
    """What gives freed memory back to the system; nothing where the C library has no such function."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


def release() -> None:
    """Give freed memory back to the system, as idle Python workers would else hold what their largest portion took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def portions(batches, column: int, size: int = 2 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many bytes in the column, but one text at least, and so many rows.

    Memory is given back after each.
    """
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(length)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right"))
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            release()
            at = to
