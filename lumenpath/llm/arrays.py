"""Text kernels over whole Arrow columns.

A batch's text column is one byte buffer plus row offsets. Words, shingles and statistics are found for
all rows of a run at once, so Python's cost is per run, not per document or word. Runs hold about
``RUN_BYTES`` of text (a single longer text is a run of its own), which bounds the memory of a task.
A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 21
RUN_ROWS = 60_000

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U64(0xD6E8FEB86659FD93)

#: The white space of a word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_CODES = np.random.default_rng(20_240_607).integers(0, 1 << 64, 256, dtype=U64)
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CODES_LOWER = _CODES[_LOWER]

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        table = np.full(size, base, U64)
        table[0] = 1
        _powers[base] = have = np.cumprod(table, dtype=U64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U64(32))
    h = h * _STEP
    h ^= h >> U64(29)
    h = h * U64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> U64(32))


def text_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and its row offsets (rows + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; each has one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), i + RUN_ROWS, n)
        yield i, j
        i = j


class Words:
    """Words of a run of rows: `first` (rows + 1) bounds each row's words; `start` and `end` are byte positions."""

    __slots__ = ("first", "start", "end", "hash", "counts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        rows = offsets[:-1][offsets[1:] > offsets[:-1]]
        solid = ~SPACE[data]
        begin, stop = solid.copy(), solid.copy()
        if n:
            begin[1:] &= ~solid[:-1]
            begin[rows] = solid[rows]
            stop[:-1] &= ~solid[1:]
            ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
            stop[ends] = solid[ends]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        code = (_CODES_LOWER if lower else _CODES)[data]
        code *= _power_table(_BASE, n)
        total = np.zeros(n + 1, U64)
        np.cumsum(code, out=total[1:])
        h = total[self.end] - total[self.start]
        if n:
            h *= _power_table(_INVERSE, n)[self.start]
        self.hash = mix(h + (self.end - self.start).astype(U64))

    def __len__(self) -> int:
        return len(self.start)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each k consecutive words of one row."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = words.hash[: n - k + 1].copy()
    for j in range(1, k):
        h *= _STEP
        h += words.hash[j : n - k + 1 + j]
    last = np.repeat(words.first[1:], words.counts)[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return at, mix(h[at] + U64(k))


def distinct(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending: (row, hash, bounds of each row)."""
    if len(h):
        order = np.argsort(h)
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        row, h = row[new], h[new]
    return row, h, np.searchsorted(row, np.arange(n_rows + 1))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row; a row with fewer words has its whole sequence as one, without words none."""
    at, h = windows(words, k)
    row = words.row_of()[at] if len(at) else at
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(few):
        whole = np.empty(len(few), U64)
        for i, r in enumerate(few):
            x = 0
            for w in words.hash[words.first[r] : words.first[r + 1]].tolist():
                x = (x * int(_STEP) + w) & 0xFFFFFFFFFFFFFFFF
            whole[i] = (x + int(words.counts[r])) & 0xFFFFFFFFFFFFFFFF
        row, h = np.concatenate([row, few]), np.concatenate([h, mix(whole)])
    return distinct(row, h, len(words.counts))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i (integers or floats)."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "uf" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
