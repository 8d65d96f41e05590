"""A static binary-fuse filter (three-wise, 8-bit fingerprints) over 64-bit digests, in numpy.

Follows the published construction (Graf and Lemire, "Binary Fuse Filters",
2022); keys are peeled in whole layers, so every step is one array operation.
No key that was put in is ever missed; another key passes with chance 1/256.
"""

from __future__ import annotations

import math

import numpy as np

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # 64-bit finaliser constants
_S33, _S32, _S18 = np.uint64(33), np.uint64(32), np.uint64(18)


def _geometry(n: int) -> tuple[int, int]:
    """(segment length, number of starting segments) for n keys."""
    seg = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    total = max(int(round(n * factor)), 1)
    return seg, max(1, -(-total // seg) - 2)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> _S33)) * _MIX1
        h = (h ^ (h >> _S33)) * _MIX2
        return h ^ (h >> _S33)


def _slots(h: np.ndarray, seg: int, starts: int) -> np.ndarray:
    base = ((h >> _S32) * np.uint64(starts * seg)) >> _S32
    mask = np.uint64(seg - 1)
    one = (base + np.uint64(seg)) ^ ((h >> _S18) & mask)
    two = (base + np.uint64(2 * seg)) ^ (h & mask)
    return np.stack([base, one, two]).astype(np.int64)


def _mark(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> _S32)).astype(np.uint8)


def build(digests: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, starting segments, cells) for signed or unsigned 64-bit digests."""
    keys = np.unique(np.asarray(digests).astype(np.int64).view(np.uint64))
    n = len(keys)
    seg, starts = _geometry(n)
    size = (starts + 2) * seg
    for seed in range(1, 200):
        h = _hash(keys, seed)
        slots = _slots(h, seg, starts)
        count = np.bincount(slots.ravel(), minlength=size)
        which = np.zeros(size, np.int64)  # xor of the key numbers in a cell: the key itself where one is left
        for row in slots:
            np.bitwise_xor.at(which, row, np.arange(n))
        layers, done = [], 0
        while done < n:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            key, first = np.unique(which[single], return_index=True)
            layers.append((key, single[first]))
            done += len(key)
            for row in slots[:, key]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(which, row, key)
        if done == n:
            break
    else:
        raise RuntimeError(f"no seed peels {n} keys")
    cells, mark = np.zeros(size, np.uint8), _mark(h)
    for key, slot in reversed(layers):
        a, b, c = slots[:, key]
        cells[slot] = 0
        cells[slot] = mark[key] ^ cells[a] ^ cells[b] ^ cells[c]
    return seed, seg, starts, cells.tobytes()


def contains(digests: np.ndarray, seed: int, seg: int, starts: int, cells: bytes) -> np.ndarray:
    h = _hash(np.asarray(digests).astype(np.int64).view(np.uint64), seed)
    a, b, c = _slots(h, seg, starts)
    f = np.frombuffer(cells, np.uint8)
    return (f[a] ^ f[b] ^ f[c]) == _mark(h)
