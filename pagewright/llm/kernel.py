"""Byte-level kernels: whole texts as numpy arrays, without a Python step for each word.

Texts are UTF-8 bytes. A null text counts as an empty one everywhere. A word is a maximal run of
bytes outside 0x20 and 0x09-0x0D, which equals the class ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21  # texts are worked on in runs of about 2 MB, which bounds memory
_U = np.uint64
_M1, _M2, _BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def trim() -> None:
    """Give memory that earlier batches used back to the machine: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def given_back(run):
    """A function of one table or two whose memory goes back to the machine when it is done, not when the next one comes."""

    def one(table):
        out = run(table)
        trim()
        return out

    def two(left, right):
        out = run(left, right)
        trim()
        return out

    return one if run.__code__.co_argcount == 1 else two


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a permutation of the 64-bit integers."""
    x = x ^ (x >> _U(30))
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def seeds(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed)) | _U(1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = seeds(1, 256)


def columns(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls have no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if "string" in str(arr.type) else b"")
    _, off, data = arr.buffers()
    if not len(arr) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if big else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def runs(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def chunks(arr, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each run of rows."""
    data, off = columns(arr)
    for i, j in runs(off, most):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
            with np.errstate(over="ignore"):
                for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                    a = np.full(m, _U(b))
                    a[0] = 1
                    setattr(self, name, np.cumprod(a))
        return self.up, self.down


_POWERS: list[Powers] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        _POWERS.append(Powers())
    return _POWERS[0].upto(n)


class Words:
    """The words of a run of texts: where they start and end, and which belong to which text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, fold: bool = True, gap: np.ndarray = SPACE) -> None:
        n = len(data)
        self.fold = fold  # hashes see A-Z as a-z
        solid = ~gap[data]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        first, last = solid.copy(), solid.copy()
        if n:
            first[1:] &= ~solid[:-1] | cut[1:n]
            last[:-1] &= ~solid[1:] | cut[1:n]
        self.data, self.off, self.n_docs = data, off, len(off) - 1
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, off)  # words of text i: at[i]..at[i+1]
        self.count = np.diff(self.at)
        self._sums = None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.count)

    def sums(self) -> np.ndarray:
        """Prefix sums of a polynomial hash, so that any slice hashes in constant time."""
        if self._sums is None:
            up, _ = powers(len(self.data) + 1)
            with np.errstate(over="ignore"):
                self._sums = np.zeros(len(self.data) + 1, _U)
                np.cumsum(_BYTE[LOWER[self.data] if self.fold else self.data] * up[: len(self.data)], out=self._sums[1:])
        return self._sums

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes start..end."""
        s = self.sums()
        _, down = powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            return mix((s[end] - s[start]) * down[start] + (end - start).astype(_U))

    def hashes(self) -> np.ndarray:
        return self.slices(self.start, self.end)


_FIVE = seeds(5, 8)


def windows(h: np.ndarray, at: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each window of n words inside one text, index of its first word, windows of each text)."""
    if len(h) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(len(count), np.int64)
    with np.errstate(over="ignore"):
        m = len(h) - n + 1
        s = h[:m] * _FIVE[0]
        for i in range(1, n):
            s = s + h[i : i + m] * _FIVE[i]
        per = np.maximum(count - (n - 1), 0)
        within = np.arange(m) - np.repeat(at[:-1], count)[:m] < np.repeat(per, count)[:m]
        first = np.flatnonzero(within)
        return mix(s[first]), first, per


def sort_within(v: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A copy of v, sorted inside each slice bounds[i]..bounds[i+1]."""
    v = v.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            v[a:b].sort()
    return v


def grouped(batches, column: str) -> Iterator[pa.Table]:
    """The rows of each value of a column by which the batches are sorted; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        v = b.column(column).to_numpy()
        cut = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for i, j in zip(cut[:-1], cut[1:]):
            if held and held[-1].column(column)[-1].as_py() != v[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)
