"""Row-local transforms of an array column, as Spark expressions (no Python in the data path)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once a row. Without it the optimiser may put the expression of a value into
    a lambda, where it runs again for every cell."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return bound(x, lambda v: total(v) / F.size(v))


def _sd(x: Column, ddof: int) -> Column:
    return bound(total(x) / F.size(x), lambda m: F.sqrt(total(F.transform(x, lambda v: (v - m) * (v - m))) / (F.size(x) - ddof)))


def sd(x: Column, ddof: int = 0) -> Column:
    return bound(x, lambda v: _sd(v, ddof))


def snv(x: Column) -> Column:
    """Standard normal variate: row mean 0, row deviation 1 (population; a constant row keeps scale 1)."""

    def scale(row: Column) -> Column:
        s = F.struct((total(row) / F.size(row)).alias("m"), _sd(row, 0).alias("s"))
        return bound(s, lambda t: F.transform(row, lambda v: (v - t["m"]) / F.when(t["s"] == 0, 1.0).otherwise(t["s"])))

    return bound(x, scale)


def l2_normalize(x: Column) -> Column:
    return bound(x, lambda row: bound(F.sqrt(dot(row, row)), lambda n: F.transform(row, lambda v: v / F.when(n == 0, 1.0).otherwise(n))))


def constants(values: np.ndarray) -> Column:
    """Numbers as one literal: the text of them is split and cast when the plan is optimised, so that a plan
    has one node for any number of channels."""
    return F.split(F.lit(",".join(repr(float(v)) for v in np.asarray(values).ravel())), ",").cast("array<double>")


def msc(x: Column, reference: Column) -> Column:
    """Scatter correction against a reference spectrum: (x - a) / b with b = cov(ref, x) / var(ref).

    |b| <= 1e-12: x - a. A flat reference (variance under 1e-12): x - mean(x)."""

    def correct(t: Column) -> Column:
        row, ref, mr, mx = t["x"], t["r"], t["mr"], t["mx"]
        var = total(F.transform(ref, lambda r: (r - mr) * (r - mr))) / F.size(ref)
        cov = total(F.zip_with(ref, row, lambda r, v: (r - mr) * (v - mx))) / F.size(row)
        line = F.struct(var.alias("var"), (cov / F.when(var < 1e-12, None).otherwise(var)).alias("b"))

        def apply(c: Column) -> Column:
            a = mx - c["b"] * mr
            return F.transform(row, lambda v: F.when(c["var"] < 1e-12, v - mx).when(F.abs(c["b"]) <= 1e-12, v - a).otherwise((v - a) / c["b"]))

        return bound(line, apply)

    return bound(F.struct(x.alias("x"), reference.alias("r")), lambda t: bound(F.struct(t["x"].alias("x"), t["r"].alias("r"), mean(t["r"]).alias("mr"), mean(t["x"]).alias("mx")), correct))


def affine(x: Column, shift: Column, scale: Column) -> Column:
    """(x - shift) / scale, cell by cell; a zero scale counts as one."""
    return F.transform(F.arrays_zip(x.alias("a"), shift.alias("b"), scale.alias("c")), lambda t: (t["a"] - t["b"]) / F.when(t["c"] == 0, 1.0).otherwise(t["c"]))


def savgol_weights(window: int = 7, poly: int = 2, deriv: int = 1) -> np.ndarray:
    """Row k: the weights that give the derivative at place k of a window from its values, by the polynomial
    fitted to them."""
    if window % 2 == 0 or poly >= window:
        raise ValueError("the window must be odd and above poly")
    h = window // 2
    fit = np.linalg.pinv(np.vander(np.arange(-h, h + 1), poly + 1, increasing=True))
    powers = [[np.prod(np.arange(k, k - deriv, -1)) * float(at) ** (k - deriv) if k >= deriv else 0.0 for k in range(poly + 1)] for at in range(-h, h + 1)]
    return np.array(powers) @ fit


def savgol_kernel(p: int, window: int = 7, poly: int = 2, deriv: int = 1) -> np.ndarray:
    """The p x p matrix D with x D the Savitzky-Golay filtered row; edges take the polynomial fitted to the
    first and last window."""
    if window > p:
        raise ValueError("the window must be odd, above poly and at most the number of channels")
    weights = savgol_weights(window, poly, deriv)
    out = np.zeros((p, p))
    for j in range(p):
        start = min(max(j - window // 2, 0), p - window)
        out[start : start + window, j] = weights[j - start]
    return out


def savgol(x: Column, window: int = 7, poly: int = 2, deriv: int = 1) -> Column:
    """The filtered row, at any number of channels: window x window weights are all that the expression holds.
    Null for a row shorter than the window."""
    weights = constants(savgol_weights(window, poly, deriv))

    def filtered(row: Column) -> Column:
        start = lambda j: F.least(F.greatest(j - window // 2, F.lit(0)), F.size(row) - window)
        return F.transform(F.sequence(F.lit(0), F.size(row) - 1), lambda j: dot(F.slice(row, start(j) + 1, F.lit(window)), F.slice(weights, (j - start(j)) * window + 1, F.lit(window))))

    return bound(x, lambda row: F.when(F.size(row) >= window, filtered(row)))


def two_taps(x: Column, left: np.ndarray, right: np.ndarray, share: np.ndarray) -> Column:
    """For each output x[left] (1 - share) + x[right] share."""
    a, b, s = constants(left).cast("array<int>"), constants(right).cast("array<int>"), constants(share)
    taps = F.arrays_zip(a.alias("a"), b.alias("b"), s.alias("s"))
    return bound(x, lambda row: F.transform(taps, lambda t: F.get(row, t["a"]) * (1 - t["s"]) + F.get(row, t["b"]) * t["s"]))


def banded(x: Column, kernel: np.ndarray) -> Column:
    """x K for a matrix whose columns have their non-zeros close together: each output is the product of a
    slice of x and a slice of one literal of weights, so the expression has one size for any width."""
    p, outputs = kernel.shape
    spans = [np.flatnonzero(kernel[:, j]) for j in range(outputs)]
    width = max((int(s[-1] - s[0]) + 1 for s in spans if len(s)), default=1)
    starts = [min(int(s[0]) if len(s) else 0, p - width) for s in spans]
    weights = constants(np.concatenate([kernel[a : a + width, j] for j, a in enumerate(starts)]))
    taps = constants(np.array(starts)).cast("array<int>")
    return bound(x, lambda row: F.transform(taps, lambda a, j: dot(F.slice(row, a + 1, F.lit(width)), F.slice(weights, j * width + 1, F.lit(width)))))


def finite(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def products(x: Column, weights: np.ndarray, offsets: np.ndarray) -> Column:
    """x W + offsets as an array: one expression with two literals, however many columns W has."""
    p = len(weights)
    if not len(offsets):
        return F.array().cast("array<double>")
    flat = constants(np.asarray(weights).T)
    return bound(x, lambda row: F.transform(constants(offsets), lambda o, k: dot(row, F.slice(flat, k * p + 1, F.lit(p))) + o))


def softmax(x: Column) -> Column:
    def share(row: Column) -> Column:
        e = bound(F.array_max(row), lambda top: F.transform(row, lambda v: F.exp(v - top)))
        return bound(e, lambda w: bound(total(w), lambda t: F.transform(w, lambda v: v / t)))

    return bound(x, share)


def clip_normalize(x: Column) -> Column:
    """Scores cut to [0, 1] over their sum; all zero stays zero. Another rule than softmax, for scoring."""
    cut = F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return bound(cut, lambda c: bound(total(c), lambda s: F.transform(c, lambda v: F.when(s > 0, v / s).otherwise(0.0))))
