"""Whole numbers as bytes, small ones short."""

from __future__ import annotations

import numpy as np


def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 7 bits a byte, the low ones first; the top bit says that more follow. And where each begins, and the last ends."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1) << np.uint64(7 * k)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        own = np.flatnonzero(size > k)
        out[at[own] + k] = ((x[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
    return out, at


def unpack(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each ends."""
    ends = np.flatnonzero(b < 128) + 1
    start = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    out, size = np.zeros(len(ends), np.uint64), ends - start
    for k in range(int(size.max()) if len(size) else 0):
        own = np.flatnonzero(size > k)
        out[own] |= (b[start[own] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64), ends
