"""Words, hashes and windows of many texts at once, on their UTF-8 bytes (numpy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_PRIME = U(0x9E3779B97F4A7C15)


def utf8_column(arr) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column's bytes and offsets; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def of_texts(texts: list) -> tuple[np.ndarray, np.ndarray]:
    return utf8_column(pa.array(texts, pa.string()))


def row_slices(offsets: np.ndarray, max_bytes: int):
    """Row ranges of about max_bytes each; every row whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def byte_set(*ranges) -> np.ndarray:
    lut = np.zeros(256, bool)
    for r in ranges:
        lut[r if isinstance(r, int) else slice(r[0], r[1] + 1)] = True
    return lut


#: Word bytes: anything but ASCII white space; letters and digits and all beyond ASCII.
NOT_SPACE = ~byte_set(0x20, (0x09, 0x0D))
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


with np.errstate(over="ignore"):
    _VALUE = mix((np.arange(256, dtype=np.uint64) + U(1)) * _PRIME)
_POWERS = np.zeros(0, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 64, 2 * len(_POWERS))
        table = np.full(size, U(0xD6E8FEB86659FD93), np.uint64)
        table[0] = 1
        _POWERS = np.cumprod(table, dtype=np.uint64)
    return _POWERS


class Spans:
    """Maximal runs of `member` bytes: starts, ends, and first[d]..first[d+1], the runs of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        n = len(data)
        inside = member[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:n]
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each run's bytes, through the byte map `fold` (lower case, say)."""
        return range_hashes(self.data, self.starts, self.ends, fold)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Hashes of byte ranges that ascend and don't overlap; an empty range hashes as its length."""
    lens = ends - starts
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    total = int(lens.sum())
    at = np.concatenate(([0], np.cumsum(lens)))
    within = np.arange(total) - np.repeat(at[:-1], lens)
    value = _VALUE if fold is None else _VALUE[fold]
    terms = value[data[np.repeat(starts, lens) + within]]
    terms *= powers(int(lens.max()) + 1)[within]
    sums = np.zeros(len(starts), np.uint64)
    full = lens > 0
    if total:
        sums[full] = np.add.reduceat(terms, at[:-1][full])
    return mix(sums + lens.astype(np.uint64) * _PRIME)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of each position the hash of n consecutive word hashes; positions whose window leaves the array are cut off."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * U(0xC2B2AE3D27D4EB4F) + hashes[k : k + m]
    return mix(out + U(n))


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Word positions where a window of n words of one text begins."""
    counts = np.diff(first)
    room = np.maximum(counts - n + 1, 0)
    at = np.concatenate(([0], np.cumsum(room)))
    return np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], room)


def covered(starts: np.ndarray, n, size: int) -> np.ndarray:
    """Which of `size` positions lie in [start, start + n)."""
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + n, -1)
    return np.cumsum(delta[:-1]) > 0


def sums_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over first[d]..first[d+1]."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[first[1:]] - total[first[:-1]]
