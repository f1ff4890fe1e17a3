"""Text columns as NumPy: UTF-8 buffers, words, and hashes of words and of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text that one NumPy pass holds; the arrays beside it are a few dozen times that
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
BYTE_HASH = np.random.Generator(np.random.PCG64(20240517)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits, for words without punctuation.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            for name, x in (("up", _BASE), ("down", _BACK)):
                a = np.full(size, x, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_powers = Powers()


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]`` (uint64) for many spans at once: prefix sums of a polynomial."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def slices(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes of text, of one row at least."""
    if not len(col):
        return
    n = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cum, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null is an empty text."""
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(buf: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes that are no breaks), and the offsets of each text's words."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = breaks[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[1:] |= gap
    start = np.flatnonzero(edge[:n] & ~gap)
    edge[:] = False
    edge[off] = True
    edge[:n] |= gap
    end = np.flatnonzero(edge[1:] & ~gap) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(col: pa.Array, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and the offsets of each text's words."""
    buf, off = utf8(col)
    start, end, at = words(buf, off, breaks)
    return spans_hash(BYTE_HASH[buf], start, end) if len(start) else np.zeros(0, np.uint64), at


def runs_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` values, by the place of its first."""
    n = max(0, len(hashes) - k + 1)
    i = np.arange(n)
    return spans_hash(hashes, i, i + k)
