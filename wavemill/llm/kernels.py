"""NumPy kernels over Arrow string columns: word spans, word hashes and shingle sets, without a Python object per word.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A null text has no words. Hashes are
64 bits: a polynomial over a random table of byte values (fixed seed), followed by an avalanche step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240611)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_TABLE[65:91] = _TABLE[97:123]
BASE = 0x9E3779B97F4A7C15
_STEP = U64(0xD6E8FEB86659FD93)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that a kernel works on at once; a longer text is a piece of its own.
PIECE = 2 << 20
#: Bytes under one table of powers: hashes of longer texts are made block by block, so the tables never grow.
BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_UP, _DOWN = _powers(BASE, BLOCK), _powers(pow(BASE, -1, 2**64), BLOCK)
_HIGH = pow(BASE, BLOCK, 2**64)


_libc: list = []


def _prepare() -> None:
    if _libc:
        return
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which otherwise rises with what is freed
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
        _libc.append(libc.malloc_trim)
        pa.set_memory_pool(pa.system_memory_pool())
    except (OSError, AttributeError):  # another libc
        _libc.append(lambda _: None)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    _libc[0](0)


def lean(run: Callable) -> Callable:
    """A function of Arrow batches whose worker gives memory back: large arrays are mapped on their own, Arrow allocates by
    the same rules, and what is free is returned when the task ends. Workers live on between tasks and stages."""

    @wraps(run)
    def own(batches):
        _prepare()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return own


def lean_group(run: Callable) -> Callable:
    """The same for a function of a group's table; what is free is returned after large groups."""

    @wraps(run)
    def own(t: pa.Table) -> pa.Table:
        _prepare()
        size = t.nbytes
        out = run(t)
        if size > 1 << 20:
            del t
            _give_back()
        return out

    return own


def mix(h: np.ndarray) -> np.ndarray:
    """An avalanche step on 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and each text's offset; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes together, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def prefix_hash(data: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """For each byte the sum of its block's values up to it, each times base**(its place in the block)."""
    c = table[data]
    for i in range(0, len(c), BLOCK):
        part = c[i : i + BLOCK]
        part *= _UP[: len(part)]
        np.cumsum(part, out=part)
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans (none is empty): the sum of value times base**(place in the span), and an avalanche step."""
    if not len(start):
        return np.zeros(0, np.uint64)
    low = start & (BLOCK - 1)
    x = c[end - 1] - np.where(low > 0, c[np.maximum(start, 1) - 1], U64(0))
    x *= _DOWN[low]
    for k in np.flatnonzero((start >> 16) != ((end - 1) >> 16)).tolist():  # over a block's end
        x[k] = _long_span(c, int(start[k]), int(end[k]))
    return mix(x)


def _long_span(c: np.ndarray, start: int, end: int) -> np.uint64:
    total, low = 0, start % BLOCK
    down = pow(BASE, -low, 2**64)
    at = start
    while at < end:
        stop = min(end, at - at % BLOCK + BLOCK)
        total += (int(c[stop - 1]) - (int(c[at - 1]) if at % BLOCK else 0)) * down
        down = down * _HIGH % 2**64
        at = stop
    return U64(total % 2**64)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row (one more entry at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    gap = SEPARATOR[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    word = ~gap
    begin = word.copy()
    begin[1:] &= gap[:-1] | first[1:n]
    stop = word
    stop[:-1] &= gap[1:] | first[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, offsets)


def words(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of a string column: first and last row, the hashes of all words, and each row's place among them."""
    data, off = utf8(column)
    for i, j in pieces(off):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        start, end, at = spans(part, o)
        yield i, j, span_hash(prefix_hash(part), start, end), at


def shingles(column, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of `size` words; with fewer words, of the whole sequence."""
    for i, j, h, at in words(column):
        grams = np.zeros(0, np.uint64)
        if len(h) >= size:
            grams = h[: len(h) - size + 1].copy()
            for k in range(1, size):
                grams = grams * _STEP + h[k : len(h) - size + 1 + k]
            grams = mix(grams)
        for r in range(j - i):
            a, b = at[r], at[r + 1]
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b == a:
                yield np.zeros(0, np.uint64)
            else:
                g = U64(int(b - a))
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        g = g * _STEP + x
                yield mix(np.array([g], np.uint64))
