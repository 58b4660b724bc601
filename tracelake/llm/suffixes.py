"""Anchors of repeated windows over sequences of 64-bit codes (of bytes or of words), and the depth-limited radix passes that find the repeats."""

from __future__ import annotations

import numpy as np

from tracelake.llm import _bytes as B

GRAM = 64


def anchors(codes: np.ndarray, prefix: np.ndarray, offs: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(position, lo, hi, key): winnowed grams that stand for all windows, as positions in codes (prefix: their sums).

    Each window of `window` elements stands under the leftmost smallest hash of its grams. Equal windows have
    equal grams, so they stand under equal keys at the same distance. lo..hi are the starts of the
    windows that one gram stands for; every window of a document belongs to exactly one entry.
    """
    w = window - gram + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(codes) < window:
        return none
    n = len(codes) - gram + 1
    _, ip = B.powers(len(codes))
    v = B.mix((prefix[gram:] - prefix[:n]) * ip[:n])
    low = v.copy()  # smallest of the next w grams, by doubling
    size = 1
    while size < w:
        step = min(size, w - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    # window starts that stay within a document
    m = len(low)
    room = np.repeat(offs[1:], np.diff(offs))[:m] - np.arange(m) >= window
    change = np.r_[True, (low[1:] != low[:-1]) | (room[1:] != room[:-1]) | np.isin(np.arange(1, m), offs)]
    a = np.flatnonzero(change)
    b = np.r_[a[1:], m]
    keep = room[a]
    a, b = a[keep], b[keep]
    if not len(a):
        return none
    view = np.lib.stride_tricks.sliding_window_view(v, w)
    pos = np.concatenate([a[i : i + 4096] + view[a[i : i + 4096]].argmin(axis=1) for i in range(0, len(a), 4096)])
    lo, hi = a, np.minimum(b - 1, pos)
    more: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(hi < b - 1):  # the same smallest hash again: the next place takes over
        q = a[i] + np.flatnonzero(v[a[i] : b[i] + w - 1] == v[pos[i]])
        start = int(hi[i]) + 1
        for x in q[q >= start]:
            if start >= b[i]:
                break
            more.append((int(x), start, min(int(b[i]) - 1, int(x))))
            start = int(x) + 1
    if more:
        x = np.array(more)
        pos, lo, hi = np.r_[pos, x[:, 0]], np.r_[lo, x[:, 1]], np.r_[hi, x[:, 2]]
    return pos, lo, hi, v[pos]


def block_digits(codes: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, pos: np.ndarray, window: int, width: int, numbers: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(row, block, core, whole): two digits for each block of neighbouring windows.

    Row r holds the elements codes[at[r]:] of the windows that start at lo[r]..hi[r]; blocks of `width` starts
    are counted from the anchor pos[r], so equal windows fall in blocks of equal number. core is the hash
    of what all windows of a full block share, whole that of all elements of the block as far as the row
    has it. numbers (row, block) restricts the result to these blocks.
    """
    if numbers is None:
        first, last = (lo - pos) // width, (hi - pos) // width
        n = last - first + 1
        row = np.repeat(np.arange(len(lo)), n)
        block = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    else:
        row, block = numbers
    shift = at[row] - lo[row]
    a0 = pos[row] + block * width
    a, z = np.maximum(a0, lo[row]), np.minimum(a0 + width - 1, hi[row])
    px = B.prefix_sums(codes)
    core = B.span_hash(px, a0 + width - 1 + shift, a0 + window + shift)
    place = (a - a0).astype(np.uint64) * np.uint64(1 << 32) + (z - a0).astype(np.uint64)
    whole = B.mix(B.span_hash(px, a + shift, z + window + shift) ^ B.mix(place + np.uint64(1)))
    return row, block, core, whole
