"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import BoundedCache, calm_collector, worker_cache

WIDTH = 5
#: Odd multipliers of the word positions, and those of the finaliser (fixed values).
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64
)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(limit: int = 200_000) -> BoundedCache:
    """Hashes of words, kept for this Python worker."""

    def build() -> BoundedCache:
        calm_collector()
        return BoundedCache(xxhash.xxh3_64_intdigest, limit)

    return worker_cache(("shingles", limit), build)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a whole text.

    A-Z are lower-cased, words are runs without ASCII blanks. Fewer words make
    one shingle of all of them; no words make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, n)
    if n < WIDTH:
        total = np.uint64(n)
        for i in range(n):
            total = mix64(total + h[i : i + 1] * _PLACES[i])[0]
        return np.array([total], np.uint64)
    s = h[: n - WIDTH + 1] * _PLACES[0]
    for i in range(1, WIDTH):
        s += h[i : n - WIDTH + 1 + i] * _PLACES[i]
    return np.unique(mix64(s))
