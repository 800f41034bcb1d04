"""Splitting whole columns of text into the pieces that byte-level BPE merges within.

The pattern of public byte-level tokenizers (letters, numbers, other signs, each with one
space before it; English contractions; white space) as operations on byte classes. Rows
with letters beyond U+024F or rare white space go through the pattern itself.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import numpy as np

from . import _vec as V

LETTER, NUMBER, SPACE, OTHER, RARE = range(5)


def _class(cp: int) -> int:
    c = chr(cp)
    if cp in (9, 10, 11, 12, 13, 32):
        return SPACE
    if cp in (0x85, 0xA0) or cp >= 0x250:
        return RARE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


_ONE = np.array([_class(b) if b < 128 else RARE for b in range(256)], np.uint8)
_TWO = np.array([_class(cp) for cp in range(0x800)], np.uint8)


def split(data: np.ndarray, off: np.ndarray, pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece, and the first piece of each row (one more at the end). pattern: of `regex`, compiled."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cls = _ONE[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xDF))
    cls[lead] = cls[lead + 1] = _TWO[((data[lead].astype(np.int64) & 31) << 6) | (data[lead + 1] & 63)]
    rare = np.concatenate([[0], np.cumsum(cls == RARE)])
    odd = rare[off[1:]] > rare[off[:-1]]
    head = np.zeros(n, bool)
    head[off[:-1][off[:-1] < n]] = True
    run = head.copy()
    run[1:] |= cls[1:] != cls[:-1]
    start = run.copy()
    # a run after white space takes one space with it; other white space before it stays a piece of its own
    after = np.flatnonzero(run[1:] & ~head[1:] & (cls[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[data[after - 1] == 32]] = False
    quote = np.flatnonzero((data == 39) & start & run)
    if len(quote):
        ends = off[np.searchsorted(off, quote, "right")]
        wide = np.zeros(n + 3, np.uint8)
        wide[:n] = data
        a, b = wide[quote + 1], wide[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (quote + 1 < ends)
        two = (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))) & (quote + 2 < ends)
        for hit, size in ((one, 2), (two & ~one, 3)):
            at = quote[hit]
            start[at + 1] = False
            stop = at + size
            stop = stop[stop < ends[hit]]
            start[stop] = True
    if odd.any():
        for i in np.flatnonzero(odd):
            a, b = int(off[i]), int(off[i + 1])
            start[a:b] = False
            for m in pattern.finditer(bytes(data[a:b]).decode("utf-8")):
                start[a] = True
                a += len(m.group().encode("utf-8"))
    at = np.flatnonzero(start)
    return at, np.append(at[1:], n), np.searchsorted(at, off)


class Codes(NamedTuple):
    """Of pieces: a hash that finds them, their first 16 bytes (zeros after the end) and their size."""

    key: np.ndarray
    head: np.ndarray
    next: np.ndarray
    size: np.ndarray


_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], V.U64)


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Codes:
    size = end - start
    wide = np.zeros(len(data) + 16, np.uint8)
    wide[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), "<u8", wide, strides=(1,))
    head = eight[start] & _MASK[np.minimum(size, 8)]
    next_ = eight[start + 8] & _MASK[np.clip(size - 8, 0, 8)]
    key = V.mix(V.mix(head + size.astype(V.U64) * V.U64(0xD6E8FEB86659FD93)) ^ next_)
    long = np.flatnonzero(size > 16)
    if len(long):
        key[long] ^= V.span_hash(V.prefix(V.TABLES[0][data]), start[long], end[long])
    return Codes(key, head, next_, size)


def same(a: Codes, i: np.ndarray, a_data: np.ndarray, a_start: np.ndarray, b: Codes, j: np.ndarray, b_data: np.ndarray, b_start: np.ndarray) -> np.ndarray:
    """Whether pieces i of a and j of b have the same bytes; the data need to hold only those of pieces of more than 16."""
    equal = (a.size[i] == b.size[j]) & (a.head[i] == b.head[j]) & (a.next[i] == b.next[j])
    long = np.flatnonzero(equal & (a.size[i] > 16))
    if len(long):
        size = a.size[i[long]]
        unlike = a_data[ragged(a_start[i[long]], size)] != b_data[ragged(b_start[j[long]], size)]
        equal[long] = np.add.reduceat(unlike, np.cumsum(size) - size) == 0
    return equal


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of the concatenation of the spans (start, size)."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)
