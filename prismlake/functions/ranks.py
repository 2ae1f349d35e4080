"""The signed-rank test of paired figures, with its exact null distribution."""

from __future__ import annotations

import math

import numpy as np

#: More pairs than this take the normal approximation.
EXACT = 200


def signed_rank(a: list[float], b: list[float]) -> tuple[float, float] | None:
    """(W, p): the smaller sum of ranks of the differences a - b, two-sided. Pairs without a difference are left
    out and equal ones share their mean rank; None if no pair differs.

    The null distribution is counted: of all ways to give the ranks signs, those with a sum as small or smaller.
    Shared ranks are halves, so sums are counted in half ranks."""
    d = np.asarray(a, float) - np.asarray(b, float)
    d = d[np.isfinite(d) & (np.abs(d) > 1e-12)]
    n = len(d)
    if n == 0:
        return None
    size = np.round(np.abs(d), 12)
    order, counts = np.unique(size, return_counts=True)
    before = np.cumsum(counts) - counts
    doubled = (2 * before + counts + 1)[np.searchsorted(order, size)]  # twice the mean rank
    total = int(doubled.sum())
    low = int(min(doubled[d > 0].sum(), doubled[d < 0].sum()))
    if n <= EXACT:
        ways = [0] * (total + 1)
        ways[0] = 1
        for r in map(int, doubled):
            for s in range(total, r - 1, -1):
                ways[s] += ways[s - r]
        return low / 2, min(1.0, 2 * sum(ways[: low + 1]) / 2**n)
    mean = n * (n + 1) / 4
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - float((counts**3 - counts).sum()) / 48)
    return low / 2, min(1.0, math.erfc((mean - low / 2) / sd / math.sqrt(2)))
