"""Vectorised text primitives on code points, shared by the operators of this subpackage.

A column batch is turned into one array of code points plus document offsets, so that
folding, filtering and shingling run as NumPy passes over whole batches instead of
per-row Python.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters handled in one NumPy pass; bounds a worker's memory whatever the batch holds.
SLICE_CHARS = 1_500_000
_TABLE = 0x110000


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fold, is_letter, is_letter_or_digit) indexed by code point.

    fold makes full-width ASCII forms and U+3000 plain, then lower-cases (one code point to one).
    """
    fold = np.arange(_TABLE, dtype=np.uint32)
    fold[0xFF01:0xFF5F] -= 0xFEE0
    fold[0x3000] = 0x20
    letter = np.zeros(_TABLE, dtype=bool)
    digit = np.zeros(_TABLE, dtype=bool)
    lower = np.arange(_TABLE, dtype=np.uint32)
    for c in range(0x30000 + 0x2000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            low = s.lower()
            if low != s and len(low) == 1:
                lower[c] = ord(low)
        elif s.isdecimal():
            digit[c] = True
    return lower[fold], letter, letter | digit


def fold_str(s: str) -> str:
    """fold of one string."""
    fold = tables()[0]
    return fold[np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)].astype("<u4").tobytes().decode("utf-32-le")


def letters_digits(s: str) -> str:
    """fold of one string, reduced to letters and digits."""
    fold, _, keep = tables()
    cp = fold[np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)]
    return cp[keep[cp]].astype("<u4").tobytes().decode("utf-32-le")


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings of a column, concatenated, and the n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    values = [(x or "") for x in col.to_pylist()]
    off = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) for v in values], out=off[1:])
    cp = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, off


def keep_only(cp: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folds and drops every code point outside the table; offsets follow."""
    cp = tables()[0][cp]
    keep = table[cp]
    cum = np.zeros(len(cp) + 1, dtype=np.int64)
    np.cumsum(keep, out=cum[1:])
    return cp[keep], cum[off]


_P = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(cp: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k code points from each position on (len - k + 1 values)."""
    n = len(cp) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    c = cp.astype(np.uint64)
    for j in range(k):
        h *= _P
        h += c[j : j + n] + np.uint64(1)
    return mix64(h)


def shingle_sets(cp: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-stretch hashes of each document; a shorter, non-empty document is one stretch."""
    h = window_hashes(cp, k)
    out = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(mix64(np.array([int.from_bytes(cp[a:b].tobytes(), "little") & (2**64 - 1)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def slices(batch: pa.RecordBatch, *text: str):
    """Row slices of a batch with about SLICE_CHARS characters each; one long row makes a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    size = np.zeros(n, dtype=np.int64)
    for c in text:
        size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cum = np.cumsum(size)
    start, base = 0, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(cum, base + SLICE_CHARS, side="right")))
        yield batch.slice(start, end - start)
        base = int(cum[end - 1])
        start = end
