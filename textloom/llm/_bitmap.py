"""Compressed bitmaps of 64-bit record identifiers, as (chunk, container) rows.

chunk = id >> bits. A container holds the low bits of one chunk's identifiers: a sorted
uint16 array while that is shorter, else a bit set of 2**bits / 8 bytes; the length tells which.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def bitset_bytes(bits: int) -> int:
    return (1 << bits) // 8


def encode(low: np.ndarray, starts: np.ndarray, bits: int) -> pa.Array:
    """Containers of groups: low is sorted and distinct within each group; starts are the groups' first positions."""
    ends = np.append(starts[1:], len(low)) if len(starts) else starts
    cards = ends - starts
    full = bitset_bytes(bits)
    dense = cards * 2 >= full
    low = low.astype("<u2")
    if not dense.any():
        offsets = np.append(starts, len(low)).astype(np.int32) * 2
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(low))])
    out = []
    for a, b, d in zip(starts, ends, dense, strict=True):
        if d:
            bitset = np.zeros(1 << bits, dtype=np.uint8)
            bitset[low[a:b]] = 1
            out.append(np.packbits(bitset, bitorder="little").tobytes())
        else:
            out.append(low[a:b].tobytes())
    return pa.array(out, pa.binary())


def decode(container: bytes, bits: int) -> np.ndarray:
    """The sorted low bits in a container."""
    if len(container) == bitset_bytes(bits):
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little")).astype(np.uint16)
    return np.frombuffer(container, "<u2")


def cardinality(container: bytes, bits: int) -> int:
    if len(container) == bitset_bytes(bits):
        return int(np.unpackbits(np.frombuffer(container, np.uint8)).sum())
    return len(container) // 2


def union(containers: list[bytes], bits: int) -> bytes:
    """Union of containers of one chunk."""
    if len(containers) == 1:
        return containers[0]
    low = np.unique(np.concatenate([decode(c, bits) for c in containers]))
    return encode(low, np.zeros(1, dtype=np.int64), bits)[0].as_py()


def contains(container: bytes, low: int, bits: int) -> bool:
    if len(container) == bitset_bytes(bits):
        return bool(container[low >> 3] >> (low & 7) & 1)
    a = np.frombuffer(container, "<u2")
    i = int(np.searchsorted(a, low))
    return i < len(a) and int(a[i]) == low


def group_ids(keys: list[np.ndarray], ids: np.ndarray, bits: int):
    """Sorts postings (keys..., id) and returns (order of group starts as key columns, chunk, containers, cardinality, occurrences).

    A posting that comes several times counts once in the container and each time in the occurrences.
    """
    order = np.lexsort((ids, *reversed(keys)))
    keys = [k[order] for k in keys]
    ids = ids[order]
    n = len(ids)
    chunk = ids >> bits
    new_group = np.ones(n, dtype=bool)
    same = chunk[1:] == chunk[:-1]
    for k in keys:
        same &= k[1:] == k[:-1]
    new_group[1:] = ~same
    first = np.ones(n, dtype=bool)
    first[1:] = new_group[1:] | (ids[1:] != ids[:-1])
    starts = np.flatnonzero(new_group)
    occ = np.diff(np.append(starts, n))
    kept = np.flatnonzero(first)
    dist_starts = np.searchsorted(kept, starts)
    card = np.diff(np.append(dist_starts, len(kept)))
    low = (ids[kept] & ((1 << bits) - 1)).astype(np.uint16)
    return [k[starts] for k in keys], chunk[starts], encode(low, dist_starts, bits), card, occ
