"""Word shingles of whole texts as sets of 64-bit numbers, in numpy."""

from __future__ import annotations

import numpy as np

# a fixed random number per byte; capital letters A-Z share those of a-z
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits (a one-to-one function of 64-bit numbers)."""
    h = (h ^ (h >> np.uint64(32))) * _Q
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every word: runs of characters other than space
    and tab to carriage return, A-Z read as a-z."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    solid = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = stop - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _P))
    words = np.add.reduceat(_BYTES[buf[solid]] * power[place], first)
    return mix(words), np.searchsorted(np.cumsum(size), start, side="right")


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: every k consecutive words; of
    fewer words the whole sequence as one; without words none."""
    h, owner = word_hashes([t or "" for t in texts])
    count = np.bincount(owner, minlength=len(texts))
    stop = np.cumsum(count)
    out = []
    if len(h) >= k:
        s = h[:len(h) - k + 1].copy()
        for i in range(1, k):
            s = s * _P + h[i:len(h) - k + 1 + i]
        s = mix(s)
    for n, e in zip(count.tolist(), stop.tolist()):
        if n >= k:
            out.append(np.unique(s[e - n:e - k + 1]))
        elif n:
            one = np.full(1, n, np.uint64)
            for i in range(e - n, e):
                one = one * _Q + h[i:i + 1]
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
