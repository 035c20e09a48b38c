"""Winnowing of hash sequences, vectorised over whole Arrow batches.

From every window of ``w`` consecutive k-gram hashes the smallest is kept (of equal ones
the last), so any run of ``w + k - 1`` symbols that two sequences share leaves at least one
common fingerprint, at the same place of the run.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all runs of k symbols along the last axis, mixed to a random order."""
    n = symbols.shape[-1] - k + 1
    h = symbols[..., :n].astype(np.uint64)
    for j in range(1, k):
        h = h * BASE + symbols[..., j : j + n]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes along the last axis, the place of its last minimum."""
    n = h.shape[-1] - w + 1
    best = h[..., :n].copy()
    at = np.zeros(best.shape, dtype=np.int64)
    for j in range(1, w):
        nxt = h[..., j : j + n]
        lower = nxt <= best
        best[lower] = nxt[lower]
        at[lower] = j
    return at + np.arange(n)


def fingerprints(values: np.ndarray, offsets: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of many sequences laid end to end.

    ``values[offsets[i]:offsets[i + 1]]`` is sequence i.  Returns the hash, the place in
    ``values`` and the sequence of each selected k-gram, in order of place.  A sequence of
    fewer than ``k + w - 1`` symbols has no window and gives no fingerprint.
    """
    none = np.zeros(0, dtype=np.int64)
    if values.size < k + w - 1:
        return none.astype(np.uint64), none, none
    h = gram_hashes(values.astype(np.uint64, copy=False), k)
    at = window_minima(h, w)
    inside = np.zeros(values.size + 1, dtype=np.int64)  # +1 where a sequence's windows begin, -1 behind their end
    windows = np.maximum(np.diff(offsets) - (k + w - 2), 0)
    some = windows > 0
    np.add.at(inside, offsets[:-1][some], 1)
    np.add.at(inside, offsets[:-1][some] + windows[some], -1)
    valid = np.cumsum(inside)[: at.size] > 0
    chosen = np.zeros(values.size, dtype=bool)
    chosen[at[valid]] = True
    places = np.flatnonzero(chosen)
    return h[places], places, np.searchsorted(offsets, places, side="right") - 1
