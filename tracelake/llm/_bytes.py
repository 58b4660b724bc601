"""Vectorised helpers over Arrow text columns: bytes, words and 64-bit hashes.

A text column is handled as one flat uint8 array plus document offsets, so that
every step costs a few numpy passes over the bytes instead of Python work a word.
Null texts are empty texts here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles; one document above this goes alone.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_pow: np.ndarray = np.ones(1, np.uint64)
_ipow: np.ndarray = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit number for each byte value.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the byte values in the inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Words of `[^\x20\x09-\x0D]+`: all bytes but six kinds of white space.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and all bytes of non-ASCII characters.
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.binary())
    if not (pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        kind = np.int32
    else:
        kind = np.int64
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about `size` bytes and `rows` rows; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    global _pow, _ipow
    if len(_pow) <= n:
        m = max(n + 1, 2 * len(_pow), 1 << 16)
        for name, b in (("_pow", _BASE), ("_ipow", pow(_BASE, -1, 1 << 64))):
            a = np.full(m, np.uint64(b & _MASK))
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _pow, _ipow


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() takes the hash of any span of a sequence of 64-bit codes; length len(codes) + 1."""
    p, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * p[: len(codes)], dtype=np.uint64, out=out[1:])
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """prefix_sums() of bytes."""
    return prefix_sums(BYTE_CODE[data])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the elements start..end: depends on these alone."""
    _, ip = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * ip[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): spans of the words, and the index of each document's first word (one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbours: len(h) - k + 1 values, none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    return mix(out)


def owner(first: np.ndarray) -> np.ndarray:
    """Document of each item, given each document's first item (one more at the end)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
