"""Vectorised byte-level tokenising and hashing of Arrow string columns.

All word rules of this subpackage are stated over ASCII bytes, so in UTF-8 a word
is a maximal run of bytes of a class and never cuts a code point.  The functions
here work on whole Arrow buffers with numpy: a few passes per byte and no Python
loop per word.  Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_POLY = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _is_space(b: int) -> bool:
    return b == 0x20 or 0x09 <= b <= 0x0D


def _is_punct(b: int) -> bool:
    """Outside digits, ASCII letters and bytes of non-ASCII characters."""
    return b < 0x80 and not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def _table(separator) -> np.ndarray:
    """A random 64-bit value per byte, 0 for separators; A-Z share the values of a-z."""
    t = mix64(np.arange(1, 257, dtype=np.uint64) * _POLY) | np.uint64(1)
    t[0x41:0x5B] = t[0x61:0x7B]
    for b in range(256):
        if separator(b):
            t[b] = 0
    return t


SPACE_TABLE = _table(_is_space)
ALNUM_TABLE = _table(_is_punct)

_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> np.ndarray:
    """Powers of the polynomial's base, and of its inverse modulo 2**64."""
    size = len(_powers.get("p", ()))
    if size < n:
        size = max(n, 1 << 16)
        inv = np.uint64(pow(int(_POLY), -1, 1 << 64))
        for key, base in (("p", _POLY), ("i", inv)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, most: int):
    """Row ranges of about `most` bytes each (a longer row stands alone)."""
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """Words of each row: (hash, start byte, end byte, offsets of rows into these)."""
    n = len(off) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(n + 1, np.int64)
    val = table[data]
    on = val != 0
    first = np.zeros(len(data) + 1, bool)
    first[off] = True  # a row's end parts words too
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, on[:-1]
    starts = np.flatnonzero(on & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, on[1:]
    ends = np.flatnonzero(on & (~after | first[1:])) + 1
    per_row = np.searchsorted(starts, off).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, per_row
    p, inv = _pow(len(data))
    val *= p[: len(data)]
    h = np.add.reduceat(val, starts) * inv[starts]
    return mix64(h ^ (ends - starts).astype(np.uint64)), starts, ends, per_row


def windows(h: np.ndarray, per_row: np.ndarray, width: int, seed: int = 1):
    """Hashes of `width` consecutive words; a shorter, not empty row is one window.

    Returns (hash, offsets of rows).  The k-th window of a row starts at its k-th word.
    """
    n = np.diff(per_row)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    off = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    if not off[-1]:
        return np.zeros(0, np.uint64), off
    row = np.repeat(np.arange(len(n)), count)
    at = per_row[row] + np.arange(off[-1]) - off[row]
    size = np.minimum(n, width)[row]
    out = np.full(off[-1], np.uint64(seed), np.uint64)
    for k in range(width):
        here = np.minimum(at + k, len(h) - 1)
        out = np.where(k < size, out * _POLY + mix64(h[here] + np.uint64(k + 1)), out)
    return mix64(out ^ size.astype(np.uint64)), off


def distinct_sets(h: np.ndarray, off: np.ndarray):
    """Sorted distinct values of each row: (values, offsets)."""
    parts = [np.unique(h[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
    size = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
