"""Vectorised text primitives over Arrow string columns.

Everything works on the UTF-8 bytes of a slice of a column at once: one pass of
table lookups and prefix sums replaces a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_POW = {1: np.ones(1, U64), -1: np.ones(1, U64)}

#: Bytes of a word: 0-9, A-Z, a-z and everything that is not ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


TABLES = [mix(np.arange(256, dtype=U64) + U64(1 + (7 << 20) * k)) | U64(1) for k in range(2)]


def powers(n: int, sign: int = 1) -> np.ndarray:
    """base^i (or base^-i) modulo 2^64 for i < n."""
    have = _POW[sign]
    if len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        step, out = U64(_BASE if sign > 0 else _INV), np.ones(size, U64)
        out[1:] = step
        np.multiply.accumulate(out, out=out)
        if size <= 1 << 22:
            _POW[sign] = out
        have = out
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base^i, with a leading zero."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span [start, end) of the values behind `sums`; it depends on content and length only."""
    inv = powers(len(sums), -1)
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole rows of about `size` bytes."""
    data, off = strings(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a row's border."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    return np.flatnonzero(mask & (~before | cut[:n])), np.flatnonzero(mask & (~after | cut[1:])) + 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the index of its first word (one more at the end)."""
    start, end = runs(WORD[data], off)
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() and a hash of each word with A-Z as a-z."""
    start, end, first = words(data, off)
    return start, end, first, span_hash(prefix(TABLES[0][LOWER[data]]), start, end)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer than k words make one shingle, none make none."""
    sums, out = prefix(hashes), []
    n = len(hashes)
    at = np.arange(max(0, n - k + 1))
    full = span_hash(sums, at, at + k) if len(at) else np.zeros(0, U64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            out.append(span_hash(sums, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, U64))
    return out


def grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted stream, each whole, several small ones of a batch one after another."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [table.column(k).to_pylist() for k in key]
        keys = list(zip(*cols))
        lo = 0
        while lo < len(keys):
            hi = lo + 1
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            if held and keys[lo] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
            last, lo = keys[lo], hi
    if held:
        yield pa.concat_tables(held)


class Forest:
    """Union-find over 0..n-1; the smallest index of a set is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
