"""Numpy primitives over whole texts: words, hashes of words and of runs of words or bytes.

Texts come as Arrow string or binary columns. They are taken in chunks of about ``CHUNK`` bytes
(one text is never cut), so that the working arrays stay small whatever the batch holds.
A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; those six never occur
inside a UTF-8 sequence, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 19
WORD_SQL = r"[^\x20\x09-\x0D]+"

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Spans of at most this many bytes are hashed side by side, longer ones each by xxHash.
LANES = 64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


#: A fixed random-looking 64-bit value for each byte.
BYTE = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and the number of the first word of each text (one more at the end)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]  # a text may begin with a word right after the last one's
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, which depends on its bytes alone.

    Eight bytes after eight are mixed in by a bijection that is not linear, for all spans at once; no two spans of one
    length up to eight bytes are ever hashed alike. Sums of powers would be cheaper, but modulo 2**64 they
    are equal for whole families of texts.
    """
    size = ends - starts
    whole = np.zeros(len(buf) + 8, np.uint8)
    whole[: len(buf)] = buf
    eight = np.ndarray(len(buf) + 1, dtype="<u8", buffer=whole, strides=(1,))  # the eight bytes from each position on
    out = mixed((size.astype(U) + U(1)) * U(_BASE))
    live = np.flatnonzero((size > 0) & (size <= LANES))
    at = 0
    while len(live):
        left = size[live] - at
        part = eight[starts[live] + at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * np.minimum(left, 8).astype(U)))
        out[live] = mixed(out[live] * U(_BASE) ^ part)
        at += 8
        live = live[left > 8]
    long = np.flatnonzero(size > LANES)
    if len(long):
        view = memoryview(whole)
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), dtype=U, count=len(long))
    return out


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values, by doubling; shorter by k - 1."""
    n, m = len(h), 1
    if n < k:
        return np.zeros(0, dtype=U)
    while 2 * m <= k:
        h = _joined(h[:-m], h[m:], m)
        m *= 2
    return h if m == k else _joined(h[: n - k + 1], h[k - m : k - m + n - k + 1], k)


def _joined(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    out = a * U((_BASE * (2 * m + 1) + 0x632BE59BD9B4E01A) % (1 << 64) | 1)
    out += b
    out ^= out >> U(29)
    out *= U(0xBF58476D1CE4E5B9)
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values; shorter by w - 1."""
    n, m = len(x), 1
    if n < w:
        return x[:0]
    while 2 * m <= w:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return x if m == w else np.minimum(x[: n - w + 1], x[w - m : w - m + n - w + 1])


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0
