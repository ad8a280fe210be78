"""Anchors: positions chosen by content, so that equal strings of a given length share one."""

from __future__ import annotations

import numpy as np

from geolith.llm.tokens import mix

#: Bytes of an anchor's own string.
GRAM = 20
STEP = 1 << 15


def gram_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hash of grams whose first, next and last eight bytes are a, b and c."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(1)) + c * np.uint64(0xC2B2AE3D27D4EB4F))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 20 bytes that begin at each position but the last 19."""
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    return gram_hash(x[:-12], x[8:-4], x[12:])


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` neighbours."""
    reach = 1
    while reach * 2 <= width:
        x = best(x[:-reach], x[reach:])
        reach *= 2
    return best(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text: in each ``length`` bytes the gram of smallest hash, all of them on a tie."""
    width = length - GRAM + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, values = [], []
    for start in range(0, len(data) - length + 1, STEP):
        block = data[start : start + STEP + length - 1]
        h = gram_hashes(block)
        least = sliding(h, width, np.minimum)
        padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        padded[width - 1 : width - 1 + len(least)] = least
        at = np.flatnonzero(h == sliding(padded, width, np.maximum))
        places.append(at + start)
        values.append(h[at])
    at, h = np.concatenate(places), np.concatenate(values)
    if len(places) > 1:
        at, first = np.unique(at, return_index=True)
        h = h[first]
    return at, h
