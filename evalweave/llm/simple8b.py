"""Simple-8b word-aligned coding of ids, vectorised per block.

A 64-bit word holds a selector in its top four bits and 60 bits of values: many narrow ids or few
wide ones. An id too wide for any shared word escapes to a word of its own. Words never span
documents, so a document decodes from its own words alone.
"""

from __future__ import annotations

from array import array

import numpy as np

# Fixed values of the format: values per word and bits per value, for selectors 1 to 14.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
# Bits of each 16-bit number, one at least.
NARROW = np.array([max(1, v.bit_length()) for v in range(1 << 16)], np.int8)


def pack(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``ids`` (below 2**60), and for each document (``ends``: its end in ids) its end in words."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, "<u8"), np.zeros(len(ends), np.int64)
    ids = ids.astype(np.uint64)
    owner = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    top = int(ids.max()).bit_length()
    if top <= 16:
        width = NARROW[ids.astype(np.uint16)]
    else:
        width = np.ones(n, np.int8)
        for b in range(1, top):
            width += ids >= np.uint64(1 << b)
    best, widest = np.ones(n, np.int8), width.copy()
    for count in range(2, min(60, n) + 1):
        last = n - count + 1
        widest = np.maximum(widest[:last], width[count - 1 :])
        if count not in COUNTS:
            continue
        fits = (widest <= WIDTHS[np.flatnonzero(COUNTS == count)[0]]) & (owner[:last] == owner[count - 1 :])
        if not fits.any():
            break  # wider words hold fewer values, so no larger count fits either
        np.maximum(best[:last], fits.view(np.int8) * np.int8(count), out=best[:last])
    # Only the places on the way are read, so the rest never become Python numbers.
    follow, starts, at = memoryview(np.arange(n, dtype=np.int32) + best), array("i"), 0
    add = starts.append
    while at < n:
        add(at)
        at = follow[at]
    first = np.frombuffer(starts, np.int32).astype(np.int64)
    held = best[first].astype(np.int64)
    words = np.zeros(len(first), "<u8")
    for selector in range(1, 15):
        mine = np.flatnonzero(held == COUNTS[selector])
        if len(mine):
            word = np.full(len(mine), selector << 60, np.uint64)
            for j in range(COUNTS[selector]):
                word |= ids[first[mine] + j] << np.uint64(WIDTHS[selector] * j)
            words[mine] = word
    return words, np.searchsorted(first, ends, "left")


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of ``words``."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    stops = np.cumsum(counts)
    out = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint64)
    for selector in range(1, 15):
        mine = np.flatnonzero(selectors == selector)
        if len(mine):
            mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
            start = stops[mine] - COUNTS[selector]
            for j in range(COUNTS[selector]):
                out[start + j] = words[mine] >> np.uint64(WIDTHS[selector] * j) & mask
    return out
