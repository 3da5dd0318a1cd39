"""Sets of word shingles as sorted 64-bit hashes, worked out for many texts at once with NumPy."""

from __future__ import annotations

import numpy as np

WORDS = 5
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(31337)
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 8 + 5
_UP = np.zeros(0, np.uint64)
_DOWN = np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _powers(n: int):
    global _UP, _DOWN
    if len(_UP) < n:
        n = max(n, SLICE)
        up, down = np.full(n, _BASE % (1 << 64), np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _UP, _DOWN = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _UP, _DOWN


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of lower-cased bytes; a long text is worked through in slices cut at white space."""
    space = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    hashes, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + SLICE, side="right")))
        low, high = int(start[at]), int(end[stop - 1])
        up, down = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUES[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = start[at:stop] - low, end[at:stop] - low
        hashes[at:stop] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = stop
    return start, hashes


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted: runs of WORDS words, or the whole sequence where there are fewer."""
    raw = [(t or b"").lower() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):  # as many texts as fit a slice
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) < SLICE):
            size += len(raw[stop]) + 1
            stop += 1
        part = raw[at:stop]
        at = stop
        start, h = word_hashes(np.frombuffer(b" ".join(part), np.uint8))
        cut = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in part])).tolist()
        n = max(len(h) - WORDS + 1, 0)
        runs = np.zeros(n, np.uint64)
        for k in range(WORDS):
            runs += h[k : k + n] * _PLACES[k]
        runs = mixed(runs)
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a >= WORDS:
                s = np.sort(runs[a : b - WORDS + 1])
                new = np.ones(len(s), bool)
                new[1:] = s[1:] != s[:-1]
                out.append(s[new])
            elif b > a:
                out.append(mixed((h[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
