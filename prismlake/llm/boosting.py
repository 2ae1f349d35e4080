"""Gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays.

Fitting is for a bounded sample of rows (see quality_rules.SAMPLE_ROWS); scoring walks all rows of a
batch through all trees at once by array indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees; a leaf's children are itself. roots: the first node of each tree."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                go = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(go, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least_rows: int = 10
) -> Forest:
    """Logistic loss, second-order gains on quantile histograms.

    monotone: per feature 1 (the score may only rise with it), -1 (only fall) or 0. A split whose
    children break the sign is refused, and the mean of the two children's values bounds both
    subtrees, so that the whole forest is monotone.
    """
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        at = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), lo, hi))
        nodes.append([0, np.inf, at, at, rate * value])
        if level == depth or len(rows) < 2 * least_rows:
            margin[rows] += rate * value
            return at
        best = (1e-6, -1, -1, 0.0, 0.0)
        gs, hs = g[rows].sum(), h[rows].sum()
        for j in range(d):
            if not len(cuts[j]):
                continue
            b = binned[rows, j]
            size = len(cuts[j]) + 1
            gl, hl, cl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
            gr, hr, cr = gs - gl, hs - hl, len(rows) - cl
            wl, wr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
            gain = -(gl * wl + 0.5 * (hl + l2) * wl**2) - (gr * wr + 0.5 * (hr + l2) * wr**2) + (gs * value + 0.5 * (hs + l2) * value**2)
            gain[(cl < least_rows) | (cr < least_rows) | (monotone[j] * (wr - wl) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(wl[k]), float(wr[k]))
        _, j, k, wl, wr = best
        if j < 0:
            margin[rows] += rate * value
            return at
        go = binned[rows, j] <= k
        middle = (wl + wr) / 2
        left_bounds = (lo, min(hi, middle)) if monotone[j] > 0 else (max(lo, middle), hi) if monotone[j] < 0 else (lo, hi)
        right_bounds = (max(lo, middle), hi) if monotone[j] > 0 else (lo, min(hi, middle)) if monotone[j] < 0 else (lo, hi)
        nodes[at][0], nodes[at][1] = j, float(cuts[j][k])
        nodes[at][2] = grow(rows[go], g, h, level + 1, *left_bounds)
        nodes[at][3] = grow(rows[~go], g, h, level + 1, *right_bounds)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
    table = np.array(nodes)
    return Forest(base, np.array(roots), table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], depth)
