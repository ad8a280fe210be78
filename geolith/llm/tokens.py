"""Words of many texts as hashes, in whole-array operations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
#: A word's polynomial hash needs powers of the base and of its inverse up to the block's size.
BLOCK = 1 << 18


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = (edge[1::2], edge[::2]) if len(inside) and inside[0] else (edge[::2], edge[1::2])
    if len(inside) and inside[0]:
        starts = np.concatenate([[0], starts])
    if len(inside) and inside[-1]:
        ends = np.concatenate([ends, [len(inside)]])
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which the table ``word_byte`` holds; none crosses an offset."""
    inside = word_byte[data]
    starts, ends = bounds(inside)
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of spans of bytes, for each array of ends; equal spans have equal hashes wherever they stand.

    The first array of ends is ascending and its spans contain those of the others.
    """
    out = [np.zeros(len(starts), np.uint64) for _ in ends]
    i = 0
    while i < len(starts):  # blocks of whole spans, so that the powers stay few
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends[0], a + BLOCK, "right")))
        b = int(ends[0][j - 1])
        up, down = powers(max(BLOCK, 1 << int(b - a).bit_length()))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        s = starts[i:j] - a
        low, back = sums[s], down[s]
        for own, end in zip(out, ends, strict=True):
            e = end[i:j] - a
            own[i:j] = mix((sums[e] - low) * back + (e - s).astype(np.uint64))
        i = j
    return out


def byte_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


#: Words of the shingle and quality contracts: runs of anything but space and bytes 9 to 13.
NOT_SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of letters and digits; bytes from 128 count as letters.
ALPHANUMERIC = byte_table(bytes(i for i in range(128) if not chr(i).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
