"""Vectorised word hashing over Arrow string batches.

A *word* is a maximal run of bytes that are neither ASCII white space nor ASCII
punctuation; ASCII and Latin-1 capitals are folded, so ``Ça,`` and ``ça`` are the
same word.  Words are represented by 64-bit hashes.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.int64).view(U64) | U64(1)
_P = U64(0x9E3779B97F4A7C15)
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 20
BLOCK = 4 << 20
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_P, _PINV)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (buf[off[0] : off[-1]], off - off[0]) if len(off) else (buf[:0], np.zeros(1, np.int64))


def fold(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals to small letters."""
    out = _FOLD[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    if len(at):
        x = out[at]
        x[(x >= 0x80) & (x <= 0x9E) & (x != 0x97)] += 0x20
        out[at] = x
    return out


@dataclass
class Words:
    """Words of consecutive documents: byte spans, hashes, and each document's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(documents) + 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at document ends, and each document's first run."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[off] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[edge[:-1]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def _hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    p, q = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_TABLE[buf] * p[:-1], out=total[1:])
    return (total[end] - total[start]) * q[start]


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which are in order and don't overlap.

    Works in blocks of BLOCK bytes, so a very long text takes no more memory than its bytes.
    """
    if len(buf) <= BLOCK:
        return mix(_hash(buf, start, end))
    out, i = np.zeros(len(start), U64), 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(end, a + BLOCK, "right"))
        if j > i:
            out[i:j] = _hash(buf[a : int(end[j - 1])], start[i:j] - a, end[i:j] - a)
        else:  # one span longer than a block
            j, step, factor = i + 1, U64(pow(int(_P), BLOCK, 2**64)), U64(1)
            for b in range(a, int(end[i]), BLOCK):
                part = buf[b : min(b + BLOCK, int(end[i]))]
                out[i:j] += _hash(part, np.array([0]), np.array([len(part)])) * factor
                factor = U64(int(factor) * int(step) & (2**64 - 1))
        i = j
    return mix(out)


def words(buf: np.ndarray, off: np.ndarray) -> Words:
    folded = fold(buf)
    start, end, first = runs(~_SEP[folded], off)
    return Words(start, end, span_hash(folded, start, end), first)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about `size` bytes."""
    buf, off = utf8(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    trim()


_LIBC = ctypes.CDLL(None) if sys.platform == "linux" else None


def trim() -> None:
    """Give memory that a batch has left free back to the system: a task's Python process goes on with other stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def ngram(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each position; shorter by n - 1 (empty if none fits)."""
    if n == 1:
        return h
    if len(h) < n:
        return np.zeros(0, U64)
    p, q = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p[:-1], out=total[1:])
    at = np.arange(len(h) - n + 1)
    return mix((total[at + n] - total[at]) * q[at])


def int64(column: pa.Array) -> np.ndarray:
    """An integer column without nulls as int64."""
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)
