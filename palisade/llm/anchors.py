"""Anchors: places that every copy of a long enough byte string shares.

Of the GRAM-byte strings inside a window of WINDOW bytes, the one with the least hash (the first, if
several are equal) is the window's anchor. It hangs on the window's bytes alone, so equal windows have
equal anchors at equal places, wherever they stand. Neighbouring windows mostly share one: a run of
windows with one anchor is a context, its bytes are what the windows cover.
"""

from __future__ import annotations

import numpy as np

#: An odd multiplier of the rolling hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PLACE = np.uint64((1 << 24) - 1)
#: Bytes handled at once; places take 24 bits.
MOST = 1 << 22


class Anchors:
    def __init__(self, window: int = 400, gram: int = 100):
        self.window, self.gram = window, gram
        n = MOST + 2 * window
        self.powers, self.inverses = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        for x in (self.powers, self.inverses):
            x[0] = 1
            np.cumprod(x, out=x)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Of the gram that starts at each place."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], dtype=np.uint64, out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.inverses[: len(data) - self.gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Texts are data[starts[i]:ends[i]], at most MOST bytes in all. The runs of windows that share an
        anchor and do not cross texts: text number, first window, last window, hash and place of the gram."""
        none = np.zeros(0, np.int64)
        width = self.window - self.gram + 1
        m = len(data) - self.window + 1
        if m <= 0:
            return none, none, none, none.astype(np.uint64), none
        h = self.hashes(data)
        key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        # sliding minimum: running minima to the left and right within blocks of the window's width
        padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        blocks = padded.reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(right[:m], left[width - 1 : width - 1 + m])
        place = (least & PLACE).astype(np.int64)
        text = np.full(m, -1, np.int32)
        for i in np.flatnonzero(ends - starts >= self.window).tolist():
            text[starts[i] : ends[i] - self.window + 1] = i
        first = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]) | (text[1:] != text[:-1])) + 1])
        last = np.concatenate([first[1:], [m]]) - 1
        real = text[first] >= 0
        first, last = first[real], last[real]
        return text[first].astype(np.int64), first, last, h[place[first]], place[first]
