"""Occurrences of content-chosen grams: every window of a text belongs to one of them.

A window of ``length`` bytes chooses, among its grams of ``gram`` bytes, the one
of least hash (the first, if several). Equal windows choose alike, so all
places of a repeated window lie in occurrences of one gram. Hot grams, a given
list, are chosen only by windows that hold no others: windows that reach out
of a common phrase do not gather at it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 19


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n, inverse = CHUNK + 4096, pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _hashes(part: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every gram of a part of a text."""
    up, down = _powers()
    total = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])
    h = total[gram - 1 :].copy()
    h[1:] -= total[:-gram]
    h *= down[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(21)  # 43 bits


class Hot:
    """A set of hashes of grams."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where ``h`` holds one of them."""
        some = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        return some[self.hashes[at] == h[some]]


def common_grams(texts: list[bytes], gram: int, fewest: int, most: int = 1 << 16) -> np.ndarray:
    """Hashes of the grams that at least ``fewest`` of the texts hold: the ``most`` commonest."""
    held = [np.unique(_hashes(np.frombuffer(t, np.uint8)[:CHUNK], gram)) for t in texts if len(t) >= gram]
    if not held:
        return np.empty(0, np.uint64)
    h, n = np.unique(np.concatenate(held), return_counts=True)
    h, n = h[n >= fewest], n[n >= fewest]
    return h[np.lexsort((h, -n))[:most]]


def occurrences(text: bytes, length: int = 100, gram: int = 40, hot: Hot | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of chosen grams, and the first and last start of the windows that choose each."""
    windows = len(text) - length + 1
    if windows <= 0:
        return (np.empty(0, np.int64),) * 3
    span = length - gram + 1
    places = []
    data = np.frombuffer(text, np.uint8)
    for at in range(0, windows, CHUNK):
        bare = _hashes(data[at : at + CHUNK + length - 1], gram)
        h = (bare << np.uint64(20)) | np.arange(len(bare), dtype=np.uint64)
        if hot is not None:
            h[hot.places(bare)] |= np.uint64(1 << 63)
        width = 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
        places.append((h & np.uint64(0xFFFFF)).astype(np.int64) + at)
    p = np.concatenate(places)
    lo = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return p[lo], lo, np.r_[lo[1:], windows] - 1


def keys(text: bytes, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int = 100, gram: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each gram, and of all bytes that the occurrence's windows cover."""
    digest = xxhash.xxh3_64_intdigest
    h = [digest(text[i : i + gram]) for i in p.tolist()]
    s = [digest(text[a:z], 1) for a, z in zip(lo.tolist(), (hi + length).tolist(), strict=True)]
    return np.array(h, np.uint64), np.array(s, np.uint64)
