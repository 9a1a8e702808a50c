"""Words and hashes of many texts at once, on the flat UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and U+0009..U+000D, as in the pattern ``[^\\x20\\x09-\\x0D]+``. Those six
bytes never occur inside a longer UTF-8 sequence, so working on bytes gives the same words as working on code points.
The 64-bit hash of a word is a polynomial over per-byte random values, taken from prefix sums; one pass of numpy
serves a whole batch, and no Python string is made for a word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once: bounds the temporary arrays at about 40 times this.
CHUNK = 1 << 20

U = np.uint64


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back what its allocators keep: it lives on, idle, beside the JVM."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sequence(n: int, seed: int) -> np.ndarray:
    """n fixed pseudorandom 64-bit integers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed * 1_000_003)) * U(0x9E3779B97F4A7C15))


_BYTE = sequence(256, 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_P = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_P, -1, 1 << 64)
_powers = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial's base and of its inverse."""
    if _powers.get("n", 0) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for name, base in (("p", _P), ("q", _INVERSE)):
            a = np.full(m, base, dtype=U)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
        _powers["n"] = m
    return _powers["p"], _powers["q"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset at which each row starts (one more than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where words start and end, and for each row the number of words before it (one more than rows)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    word = _WORD[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[at] = True
    before = np.concatenate(([False], word[:-1])) & ~cut[:-1]
    after = np.concatenate((word[1:], [False])) & ~cut[1:]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte spans that don't overlap and are in order; lower folds A-Z."""
    out = np.empty(len(starts), dtype=U)
    table = _BYTE[_LOWER] if lower else _BYTE
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + CHUNK, side="right")))
        b = ends[j - 1]
        p, q = _power_table(int(b - a) + 1)
        total = np.empty(b - a + 1, dtype=U)
        total[0] = 0
        np.cumsum(table[buf[a:b]] * p[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * q[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows in order, and each row's first position among them (one more than rows)."""
    buf, at = flat(column)
    starts, ends, first = words(buf, at)
    return hash_spans(buf, starts, ends, lower), first


_FACTOR = sequence(64, 2) | U(1)


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n neighbours in h, whatever rows they belong to; one for each start, len(h) - n + 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=U)
    out = np.full(m, n * 1_000_003 + seed, dtype=U)
    factor = _FACTOR if n <= 64 else sequence(n, 2) | U(1)
    for j in range(n):
        out += h[j : j + m] * factor[j]
    return mix(out)


def squeezed(column: pa.Array) -> pa.Array:
    """Each text compressed, behind its size in bytes: what a long way through a shuffle is spared. Null is empty."""
    raw = [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
    return pa.array([len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary())


def expanded(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges of squeezed texts that hold about `most` bytes each, with their texts."""
    raw = column.to_pylist()
    size = [int.from_bytes(x[:8], "little") for x in raw]
    i = 0
    while i < len(raw):
        j, n = i, 0
        while j < len(raw) and (j == i or n + size[j] <= most):
            n += size[j]
            j += 1
        texts = [pa.decompress(raw[k][8:], decompressed_size=size[k], codec="zstd", asbytes=True) if size[k] else b"" for k in range(i, j)]
        yield i, j, pa.array(texts, pa.large_binary()).cast(pa.large_string())
        i = j


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about `most` bytes each, one row at least."""
    if not len(column):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(size):
        done = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, done + most, side="right")))
        yield i, j
        i = j
