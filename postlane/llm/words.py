"""Words of UTF-8 text in numpy: where they lie and what they hash to, a block of texts at a time."""

from __future__ import annotations

import numpy as np

from postlane.llm.common import mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Byte classes: parts between white space, and runs of letters and digits (all bytes beyond ASCII count as letters).
NOT_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def lower(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the letters of Latin-1, whose second bytes follow 0xC3."""
    out = _LOWER[raw]
    if len(out) > 1:
        capital = np.flatnonzero(raw[:-1] == 0xC3) + 1
        b = out[capital]
        out[capital] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b | 0x20, b)
    return out


def spans(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word; no word runs over the end of a text."""
    n = len(raw)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = kind[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Hasher:
    """64-bit hashes of byte ranges through prefix sums of a polynomial, the powers kept between blocks."""

    def __init__(self) -> None:
        self.up = self.down = self.total = np.zeros(0, np.uint64)

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(raw)
        if len(self.up) < n + 1:
            self.up, self.down = powers(_BASE, n + 1), powers(_INVERSE, n + 1)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.total[1:])
        return self.again(starts, ends)

    def again(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of other ranges of the bytes of the last call."""
        with np.errstate(over="ignore"):
            return mix((self.total[ends] - self.total[starts]) * self.down[starts])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbouring words, by the first one's place; empty where there are under k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = total * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
        return mix(total)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    out, have = x, 1
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out[:n]
