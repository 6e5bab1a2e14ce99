"""Arrow text columns as flat numpy bytes, for the tasks of several operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at once; one longer text is taken alone.
AT_ONCE = 1 << 20
#: Words end at these bytes: those of \x20 and \x09-\x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(sizes: np.ndarray, most: int = AT_ONCE) -> list[tuple[int, int]]:
    """[low, high) stretches of rows of at most `most` bytes, or one row."""
    out, low, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > low and total + n > most:
            out.append((low, i))
            low, total = i, 0
        total += n
    return [*out, (low, len(sizes))] if len(sizes) > low else out


def lean(task: Callable) -> Callable:
    """A task that hands the memory that it no longer uses back to the system: workers live on, in other tasks too."""

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def stretch_hashes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[low:high] for each pair, whatever surrounds it (a polynomial, from running sums)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(data)), out=sums[1:])
    back = powers(_ODD_INVERSE, len(data) + 1)
    return mix((sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, first) of the words: maximal stretches of bytes that is_word marks, none across texts.

    first has one number a text and one more: the words of text i are first[i]:first[i + 1].
    """
    inside = is_word[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    starts, ends = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]]
    opens[starts] = inside[starts]
    closes[ends - 1] = inside[ends - 1]
    low, high = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return low, high, np.searchsorted(low, at)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def shingles(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its first word) of each n consecutive words of a text; a text of fewer words, but not none, is one shingle."""
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(word)) - first[:-1][text]
    left = count[text] - place
    take = np.flatnonzero((left >= n) | ((place == 0) & (count[text] < n)))
    length = np.minimum(left[take], n)
    out = length.astype(np.uint64) * _ODD
    for k in range(n):
        has = length > k
        out = np.where(has, mix(out + word[np.where(has, take + k, 0)]), out)
    return out, take
