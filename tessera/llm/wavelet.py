"""Two-dimensional range reporting over a permutation."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """The points (i, values[i]) of a permutation, one bit of the values a level.

    A level keeps how many zero bits stand before each place; the nodes of a
    level lie behind one another, those of smaller values first.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        at = np.asarray(values, np.int64)
        for b in range(self.bits - 1, -1, -1):
            zero = (at >> b) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            at = np.concatenate([at[zero], at[~zero]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of all points with left <= i < right and low <= value < high."""
        q = np.flatnonzero((right > left) & (high > low))
        a, b, base = left[q].astype(np.int64), right[q].astype(np.int64), np.zeros(len(q), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - level)
            a0, b0 = zeros[a], zeros[b]
            a1, b1 = a - a0 + zeros[-1], b - b0 + zeros[-1]
            zero = (b0 > a0) & (base < high[q]) & (base + half > low[q])
            one = (b1 > a1) & (base + half < high[q]) & (base + 2 * half > low[q])
            q, a, b, base = (np.concatenate(x) for x in ((q[zero], q[one]), (a0[zero], a1[one]), (b0[zero], b1[one]), (base[zero], base[one] + half)))
        return q, base
