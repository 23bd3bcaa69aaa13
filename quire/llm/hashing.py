"""Hashes of many stretches of bytes or numbers at once, from one running polynomial sum."""

from __future__ import annotations

import numpy as np

from quire.llm.shared import mix64

ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * ODD)


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up, self.down = (np.concatenate([x, x * np.uint64(pow(b, k, 1 << 64))]) for x, b in ((self.up, self.base), (self.down, self.inverse)))
        return self.up[:n], self.down[:n]


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[start:end] for each pair, from one running polynomial sum."""
    up, down = powers.to(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * ODD)


def word_bounds(text: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes that hold documents; ``cut``: where documents begin, in order."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[text]
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    cut = cut[cut < len(text)]
    edge[cut] = word[cut]
    start = np.flatnonzero(edge)
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = cut[cut > 0] - 1
    last[before] = word[before]
    return start, np.flatnonzero(last) + 1
