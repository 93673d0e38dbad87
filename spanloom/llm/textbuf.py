"""Vectorised views of text columns: byte buffers, word spans and what tells spans apart, in numpy.

Everything works on slices of an Arrow string column: the texts' UTF-8 bytes end to end, with an
offset per row. A slice is bounded in bytes, so the arrays made from it are bounded too, whatever
the length of an Arrow batch. A single longer text makes a slice of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 19
#: Words are runs of bytes other than these.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_P = 0x9E3779B97F4A7C15
#: Only the GNU C library has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish for 64-bit hashes, so that any of their bits can be used."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


#: Spans of so many bytes are kept as they are; of longer ones a digest.
PACKED = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Packed:
    """What tells spans of bytes apart: their length and 128 bits, which are the bytes where they fit, else their BLAKE2 digest.

    hash mixes these to 64 bits. Two spans are equal if length and all bits are; equal hashes alone don't say so.
    """

    __slots__ = ("n", "lo", "hi", "hash")

    def __init__(self, n: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.n, self.lo, self.hi = n, lo, hi
        self.hash = mix(mix(lo + n.astype(np.uint64) * np.uint64(_P)) ^ hi)

    @classmethod
    def of(cls, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> Packed:
        n = (end - start).astype(np.int64)
        if not len(n):
            return cls(n, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        padded = np.concatenate([buf, np.zeros(PACKED + 8, np.uint8)])
        eight = np.ndarray(len(buf) + PACKED, "<u8", padded, strides=(1,))
        lo = eight[start] & _MASK[np.minimum(n, 8)]
        hi = eight[start + 8] & _MASK[np.clip(n - 8, 0, 8)]
        long = np.flatnonzero(n > PACKED)
        if len(long):
            data = buf.tobytes()
            raw = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
            both = np.frombuffer(raw, "<u8").reshape(-1, 2)
            lo[long], hi[long] = both[:, 0], both[:, 1]
        return cls(n, lo, hi)

    def take(self, at: np.ndarray) -> Packed:
        return Packed(self.n[at], self.lo[at], self.hi[at])

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.lo[i] == self.lo[j]) & (self.hi[i] == self.hi[j]) & (self.n[i] == self.n[j])

    def numbers(self) -> np.ndarray:
        """A number for each span, equal for equal spans alone."""
        return identify(self.hash, self.same)


def identify(h: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Numbers from 0 for items, equal for equal items alone.

    h: hashes, which only say which items to compare. same(i, j): whether the items at i and j are equal.
    """
    out = np.zeros(len(h), np.int64)
    if not len(h):
        return out
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(h), bool)
    near = np.flatnonzero(s[1:] == s[:-1])
    alike = same(order[near], order[near + 1])
    new[near[alike] + 1] = False
    out[order] = np.cumsum(new) - 1
    if not alike.all():  # different items of one hash: each run of that hash is parted anew
        heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        ends = np.append(heads[1:], len(s))
        for k in np.unique(np.searchsorted(heads, near[~alike], side="right") - 1).tolist():
            rest = order[heads[k] : ends[k]]
            while len(rest):
                equal = same(np.full(len(rest), rest[0]), rest)
                out[rest[equal]] = out[rest[0]]
                rest = rest[~equal]
    return out


def windows(number: np.ndarray, row: np.ndarray, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(at, id): where n consecutive words of one text start, and a number for each of these windows, equal for equal ones alone.

    number: a number for each word, equal for equal words alone; hashes: strong hashes of the words, if there are some.
    """
    m = max(0, len(number) - n + 1)
    at = np.flatnonzero(row[:m] == row[n - 1 :]) if m else np.zeros(0, np.int64)
    h = sequence_hash(mix(number.astype(np.uint64) + np.uint64(1)) if hashes is None else hashes, n)[at] if m else np.zeros(0, np.uint64)

    def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.ones(len(i), bool)
        for k in range(n):
            ok &= number[at[i] + k] == number[at[j] + k]
        return ok

    return at, identify(h, same)


def sequence_hash(items: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive items (64-bit hashes themselves). It finds what may be equal; what is has to be compared."""
    if len(items) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(items) - n + 1, np.uint64)
    for j in range(n):
        h *= np.uint64(_P)
        h += items[j : j + len(h)]
    return mix(h)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    _, offs, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    o = np.frombuffer(offs, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def give_back() -> None:
    """Return what Arrow and the C library hold but don't use to the machine: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most so many bytes, or of one row: first row, end row, bytes, offsets."""
    give_back()  # the batch before is gone by now
    buf, offs = buffers(texts)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    give_back()


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each row (n + 1 numbers)."""
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf), bool)
    edge[offs[:-1][offs[:-1] < len(buf)]] = True  # a row's first byte starts a word though the byte before is solid
    before = np.empty(len(buf), bool)
    if len(buf):
        before[0] = False
        before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge))
    after = np.empty(len(buf), bool)
    if len(buf):
        after[-1] = False
        after[:-1] = solid[1:] & ~edge[1:]
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """Each row's words joined by one space: the bytes of all rows, and where each row's begin and end in them."""
    size = end - start + 1
    data = np.concatenate([buf, np.array([32], np.uint8)])[ranges(start, size)]
    ends = np.cumsum(size)
    data[ends - 1] = 32
    at = np.concatenate([[0], ends])[first]
    return data.tobytes(), [(a, b - 1 if b > a else a) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def points(buf: np.ndarray) -> np.ndarray:
    """Code points before each byte, one more number than bytes."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for start[1], ..."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)


class Table:
    """An open-addressing map from spans to row numbers, all in numpy arrays. Spans of a hit are compared, not only their hashes."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.row = np.full(1 << bits, -1, np.int32)
        self.size, self.lo, self.hi = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)

    def find(self, p: Packed) -> np.ndarray:
        """The row of each span, -1 where there is none."""
        mask = (1 << self.bits) - 1
        at = (p.hash & np.uint64(mask)).astype(np.int64)
        row = self.row[at].astype(np.int64)
        out = np.where((row >= 0) & self._is(row, p.lo, p.hi, p.n), row, -1)
        open_ = np.flatnonzero((out < 0) & (row >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            row = self.row[at[open_]].astype(np.int64)
            hit = (row >= 0) & self._is(row, p.lo[open_], p.hi[open_], p.n[open_])
            out[open_[hit]] = row[hit]
            open_ = open_[~hit & (row >= 0)]
        return out

    def _is(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.lo[row] == lo) & (self.hi[row] == hi) & (self.size[row] == n)

    def add(self, p: Packed) -> np.ndarray:
        """Rows for distinct spans that are not in the table yet, in their order."""
        m = self.n + len(p.n)
        rows = np.arange(self.n, m, dtype=np.int32)
        grown = False
        while m * 2 > 1 << self.bits:
            self.bits, grown = self.bits + 1, True
        if grown:
            more = (1 << self.bits) - len(self.lo)
            self.size, self.lo, self.hi = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.size, self.lo, self.hi))
            self.row = np.full(1 << self.bits, -1, np.int32)
            old = np.arange(self.n)
            self._put(Packed(self.size[old].astype(np.int64), self.lo[old], self.hi[old]).hash, old.astype(np.int32))
        self.size[rows], self.lo[rows], self.hi[rows] = p.n, p.lo, p.hi
        self._put(p.hash, rows)
        self.n = m
        return rows

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(rows):
            free = self.row[at] < 0
            _, first = np.unique(at, return_index=True)
            win = np.zeros(len(rows), bool)
            win[first] = True
            win &= free
            self.row[at[win]] = rows[win]
            rows, at = rows[~win], at[~win]
            taken = self.row[at] >= 0
            at[taken] = (at[taken] + 1) & mask
