"""Signatures for exact Jaccard joins: a hashed universe cut into segments, and the pigeonhole.

Two sets of sizes a and b reach the threshold p/q only if they differ in at
most H = floor((a + b) (q - p) / (q + p)) elements. Cut the universe into m
segments and give each segment of a set some *units*: one if partners with the
same subset there are looked up, two if partners whose subset differs by one
token are looked up as well (one-deletion neighbourhoods of either side).
H + 1 units suffice: if every lookup failed, the sets would differ in at least
one token for each unit.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix64

_BAND = np.uint64(0x9FB21C651E98DF25)
_PHI = 0x9E3779B97F4A7C15
#: A band in which a set does not sign has a slack that no number of signatures reaches.
NO_BAND = 1 << 30


class SegmentScheme:
    """Segments, subset signatures and one-deletion neighbourhoods for a threshold of ``num / den``.

    Band k holds the sizes from 2**k to 2**(k+1)-1 and cuts the universe into
    :meth:`segments` segments. A set signs in its own band and, if its size
    allows a partner below its band, in the next lower one too. A signature's
    lowest bit is the parity of its band, so the two are told apart.
    """

    def __init__(self, num: int = 80, den: int = 100, density: float = 1.25) -> None:
        self.num, self.den, self.density = num, den, density

    def errors(self, a: int, b: int) -> int:
        """Most elements in which sets of sizes a and b that reach the threshold differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def largest_partner(self, size: int) -> int:
        return size * self.den // self.num

    def segments(self, band: int) -> int:
        """Segments of a band, in proportion to the errors that its largest sets allow."""
        top = (2 << band) - 1
        return int(self.density * self.errors(top, top)) + 3

    def bands(self, n: int) -> list[tuple[int, int]]:
        """``(band, errors)`` of the bands in which a set of ``n`` tokens signs."""
        band = n.bit_length() - 1
        out = [(band, self.errors(n, self.largest_partner(n)))]
        below = (1 << band) - 1
        if below and n <= self.largest_partner(below):
            out.append((band - 1, self.errors(n, below)))
        return out

    def _cut(self, tokens: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segment starts, segment numbers, spread tokens and subset sums of the non-empty segments."""
        place = ((tokens >> np.uint64(32)) * np.uint64(self.segments(band))) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        spread = mix64(tokens ^ _BAND)
        return starts, place[starts], spread, np.add.reduceat(spread, starts)

    @staticmethod
    def _sign(sums: np.ndarray, band: int) -> np.ndarray:
        salt = np.uint64((band + 1) * _PHI & 0xFFFFFFFFFFFFFFFF)
        return (mix64(sums + salt) & ~np.uint64(1)) | np.uint64(band & 1)

    def subsets(self, tokens: np.ndarray) -> tuple[np.ndarray, int, int]:
        """Signatures of all whole subsets of a set of sorted hashes, and its slack in even and in odd bands.

        The slack is the number of non-empty segments less the allowed errors:
        a set that shares fewer subsets of a band has no partner there, for the
        subsets that nobody shares are H + 1 units at no cost.
        """
        slack = [NO_BAND, NO_BAND]
        out = [np.empty(0, np.uint64)]
        for band, errors in self.bands(len(tokens)) if len(tokens) else []:
            sums = self._cut(tokens, band)[3]
            out.append(self._sign(sums, band))
            slack[band & 1] = len(sums) - errors
        return np.concatenate(out), slack[0], slack[1]

    def neighbourhood(self, tokens: np.ndarray, parity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int] | None:
        """Whole subsets and one-deletion neighbourhoods in the band of that parity.

        ``(signature, segment, whole, wide, need, units)``: ``wide`` marks
        segments of two or more tokens, the only ones that can have two units,
        since empty subsets are not indexed; ``need`` is H + 1 and ``units``
        what all segments can have together. Where that is too little, a
        signature that such sets of a band have in common (segment -1) is added.
        """
        for band, errors in self.bands(len(tokens)) if len(tokens) else []:
            if band & 1 != parity:
                continue
            starts, places, spread, sums = self._cut(tokens, band)
            sizes = np.diff(np.append(starts, len(tokens)))
            wide = sizes >= 2
            owner = np.repeat(np.arange(len(starts)), sizes)
            part = wide[owner]
            sigs = [self._sign(sums, band), self._sign(sums[owner][part] - spread[part], band)]
            segs = [places, places[owner][part]]
            whole = np.zeros(len(sigs[0]) + len(sigs[1]), bool)
            whole[: len(starts)] = True
            broad = np.concatenate([wide, np.ones(len(sigs[1]), bool)])
            need, units = errors + 1, int(len(wide) + wide.sum())
            segs = np.concatenate(segs).astype(np.int32)
            if units < need:
                sigs.append(self._sign(np.array([_BAND]), band))
                segs, whole, broad = np.append(segs, np.int32(-1)), np.append(whole, True), np.append(broad, False)
            return np.concatenate(sigs), segs, whole, broad, need, units
        return None
