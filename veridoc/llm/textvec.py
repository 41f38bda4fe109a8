"""Vectorised word handling over the UTF-8 bytes of Arrow string columns (numpy, inside tasks).

A batch of texts is one byte array plus row offsets. Words and their 64-bit hashes come from whole-array passes,
so the cost per byte is some nanoseconds and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone and whole.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        # a slice ends after the text that fills it, so most are within twice its size
        size = max(n, 2 * SLICE_BYTES)
        out = np.full(size, _BASE if which == "up" else _INV, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size == 2 * SLICE_BYTES:
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Texts:
    """Rows of text as bytes: data, starts and ends of words, row of each word, word hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.n, self.raw, self.at = len(column), raw, at - at[0]
        self.data = LOWER[raw] if lower else raw
        solid = ~IS_SPACE[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[self.at] = True
        before = np.empty_like(solid)
        before[1:] = ~solid[:-1]
        after = np.empty_like(solid)
        after[:-1] = ~solid[1:]
        if len(raw):
            before[0] = after[-1] = True
        self.starts = np.flatnonzero(solid & (before | first[:-1]))
        self.ends = np.flatnonzero(solid & (after | first[1:])) + 1
        self.row = np.searchsorted(self.at, self.starts, "right") - 1
        self.words = np.bincount(self.row, minlength=self.n)  # words of each row
        self.first = np.concatenate(([0], np.cumsum(self.words)))  # first word of each row

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte spans, the words by default."""
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        if not hasattr(self, "_sums"):
            terms = _BYTE[self.data]
            terms *= _power("up", len(terms))
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        value = self._sums[ends] - self._sums[starts]
        value *= _power("down", len(self._sums))[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def text(self, start: int, end: int) -> str:
        return self.raw[start:end].tobytes().decode("utf-8", "replace")

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-word shingles: their hashes, sorted within each row, and the offsets of the rows.

        A row with fewer words has its whole sequence as its one shingle, a row without words none.
        """
        h = self.hashes() if len(self.starts) else np.zeros(0, np.uint64)
        many = np.maximum(self.words - n + 1, np.minimum(self.words, 1))
        row = np.repeat(np.arange(self.n), many)
        start = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])) if self.n else many, many) + self.first[row]
        size = np.minimum(self.words[row], n)
        value = size.astype(np.uint64)
        for k in range(n):
            inside = k < size
            part = h[np.where(inside, start + k, start)] if len(h) else np.zeros(0, np.uint64)
            value = np.where(inside, mix(value + part) * np.uint64(0x9E3779B97F4A7C15), value)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[fresh], value[fresh]
        return value, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=self.n))))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about SLICE_BYTES of text; no text is cut."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
    block = (np.cumsum(size) - size) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def parts(texts: list[str]) -> Iterator[pa.Array]:
    """Texts as Arrow strings, in runs of about SLICE_BYTES."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    for part in slices(batch):
        yield part.column(0)


def keep_freed() -> None:
    """From here on this process uses freed memory again instead of returning it at once, until give_back.

    Arrays of some 100 kB that come and go would otherwise be new pages each time, which costs more than the work on them.
    """
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option is not None:
        option(-3, 32 << 20)  # M_MMAP_THRESHOLD: what is smaller comes from the heap
        option(-1, 128 << 20)  # M_TRIM_THRESHOLD: free memory that may stay at the heap's end


def give_back() -> None:
    """Memory that this process has freed but still holds goes back to the system: workers wait for their next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def over(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text") -> Callable:
    """For mapInArrow: work on each slice of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = work(part)
                if out is not None:
                    yield out
                del out
            # most of a worker's memory was this batch's
            give_back()

    return run
