"""Hashes of all words of many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes of text whose words are hashed at once.
_PIECE = 1 << 18
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's bits, spread over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    """A number for each byte at each of 64 places in a word; A-Z as a-z."""
    table = mixed(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * MIX[0]).reshape(64, 256)
    table[:, 65:91] = table[:, 97:123]
    return table.ravel()


_LETTERS = _letters()


def word_hashes(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each word of the bytes, with A-Z as a-z; a word reaches from its place in `at` to the
    next, but only the bytes marked `inside` count."""
    out = np.empty(len(at), np.uint64)
    w = 0
    while w < len(at):
        v = max(w + 1, int(np.searchsorted(at, at[w] + _PIECE)))
        low, high = at[w], at[v] if v < len(at) else len(data)
        start = at[w:v] - low
        place = np.arange(high - low) - np.repeat(start, np.diff(np.append(start, high - low)))
        value = _LETTERS[(place & 63) * 256 + data[low:high]]
        if place.max(initial=0) > 63:
            value *= (2 * (place >> 6) + 1).astype(np.uint64)
        value[~inside[low:high]] = 0
        out[w:v] = np.add.reduceat(value, start)
        w = v
    return mixed(out)
