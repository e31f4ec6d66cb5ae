"""Vectorised text kernels shared by the operators: words and shingles of a whole Arrow batch at once.

A *word* is a run of bytes that are ASCII letters or digits or belong to a code point above U+007F; A-Z are
lower-cased first. That is the class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on lower-cased text.
Words get 64-bit hashes from a polynomial over a random byte table, taken from prefix sums, so that a batch
costs a few numpy passes over its bytes and no Python object a word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text of one slice, in bytes; it bounds the working memory of the kernels. A longer document is one slice.
SLICE_BYTES = 2 << 20


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U, copy=True)
    x += U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Byte -> lower-cased word byte, or 0 for a separator.
CODE = np.zeros(256, np.uint8)
for _i in range(256):
    if 48 <= _i < 58 or 97 <= _i < 123 or _i >= 128:
        CODE[_i] = _i
    elif 65 <= _i < 91:
        CODE[_i] = _i + 32
#: The same as a table for bytes.translate: separators become spaces.
TO_WORDS = bytes(int(c) or 32 for c in CODE)
_MIX = splitmix(np.arange(256, dtype=U) + U(1000))
_BASE, _INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _pow(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), _BASE if which == "up" else _INV, U)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(step, dtype=U)
        if len(have) <= 8 * SLICE_BYTES:  # a document beyond that pays for its own table, which isn't kept
            _powers[which] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of documents of about ``size`` bytes; rows are never cut."""
    data, off = buffers(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first word of each document with the total at the end) of a slice."""
    n = len(data)
    code = CODE[data]
    isw = code != 0
    left = np.empty(n, bool)
    if n:
        left[0] = False
        left[1:] = isw[:-1]
        left[off[:-1][off[:-1] < n]] = False
        right = np.empty(n, bool)
        right[-1] = False
        right[:-1] = isw[1:]
        ends_at = off[1:]
        right[ends_at[ends_at > 0] - 1] = False
        starts, ends = np.flatnonzero(isw & ~left), np.flatnonzero(isw & ~right) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, U)
        np.cumsum(_MIX[code] * _pow("up", n), out=acc[1:])
        h = splitmix((acc[ends] - acc[starts]) * _pow("down", n + 1)[starts] + (ends - starts).astype(U))
    return starts, ends, h, np.searchsorted(starts, off)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of k words of each document, repeats kept; a document of 1 to k-1 words is one shingle."""
    counts = np.diff(first)
    docs = np.repeat(np.arange(len(counts)), counts)
    n = len(h)
    coef = splitmix(np.arange(k, dtype=U) + U(77)) | U(1)
    with np.errstate(over="ignore"):
        if n >= k:
            m = n - k + 1
            s = h[:m] * coef[0]
            for j in range(1, k):
                s = s + h[j : j + m] * coef[j]
            good = docs[:m] == docs[k - 1 :]
            d, s = docs[:m][good], s[good]
        else:
            d, s = np.zeros(0, np.int64), np.zeros(0, U)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            pos = np.concatenate([np.arange(first[i], first[i + 1]) for i in short])
            at = pos - np.repeat(first[short], counts[short])
            part = h[pos] * coef[at]
            sums = np.add.reduceat(part, np.concatenate([[0], np.cumsum(counts[short])[:-1]]))
            d, s = np.concatenate([d, short]), np.concatenate([s, sums + counts[short].astype(U)])
    return d, splitmix(s)


def unused(df, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"{name}_" in taken:
            name += "_"
        out.append(f"{name}_")
        taken.add(out[-1])
    return out


def release() -> None:
    """Gives free memory of this process back to the system, and what can be made again in some milliseconds."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def tidy(rows: Iterator) -> Iterator:
    """Passes a task's rows on. At its end the worker, which Spark keeps for later tasks and stages, holds no memory of this one."""
    yield from rows
    del rows
    release()


def limits(spark) -> None:
    """Bounds what an Arrow batch holds by rows and bytes; long texts then come in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
