"""Latent-variable models from moments: PLS regression and PLS-DA, PCA, and what is derived from them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.functions import rowlocal as R
from prismlake.operators.gram import Moments, moments, one_hot


@dataclass
class Pls:
    """x_mean, y_mean; weights, loadings, y-loadings and rotations by component; coefficients for 1..A."""

    x_mean: np.ndarray
    y_mean: np.ndarray
    w: np.ndarray
    p: np.ndarray
    q: np.ndarray
    r: np.ndarray
    t_ss: np.ndarray

    def coefficients(self, a: int) -> np.ndarray:
        return self.r[:, :a] @ self.q[:, :a].T

    def predict(self, x: Column, a: int) -> Column:
        """All outputs as an array column, row-local."""
        b = self.coefficients(a)
        return R.products(x, b, self.y_mean - self.x_mean @ b)

    def scores(self, x: Column, a: int) -> Column:
        return R.products(x, self.r[:, :a], -(self.x_mean @ self.r[:, :a]))


def fit_pls(m: Moments, p: int, components: int) -> Pls:
    """Kernel PLS on centred cross products; the sign of each weight vector makes its largest entry positive."""
    mean, c = m.centred()
    xx, xy = c[:p, :p].copy(), c[:p, p:].copy()
    k = xy.shape[1]
    w, pl, q, r, ss = [], [], [], [], []
    for _ in range(min(components, p, int(m.n) - 1)):
        if k == 1:
            d = xy[:, 0]
        else:
            _, vectors = np.linalg.eigh(xy.T @ xy)
            d = xy @ vectors[:, -1]
        norm = np.linalg.norm(d)
        if norm < 1e-12:
            break
        d = d / norm * np.sign(d[np.argmax(np.abs(d))])
        rot = d.copy()
        for pj, rj in zip(pl, r, strict=True):
            rot -= (pj @ d) * rj
        tt = float(rot @ xx @ rot)
        if tt < 1e-12:
            break
        load = xx @ rot / tt
        yload = xy.T @ rot / tt
        xy = xy - tt * np.outer(load, yload)
        for store, value in zip((w, pl, q, r, ss), (d, load, yload, rot, tt), strict=True):
            store.append(value)
    stack = lambda v, n: np.stack(v, 1) if v else np.zeros((n, 0))
    return Pls(mean[:p], mean[p:], stack(w, p), stack(pl, p), stack(q, k), stack(r, p), np.array(ss))


def error_sum(model: Pls, a: int, m: Moments, p: int) -> np.ndarray:
    """Sum of squared errors of the model's outputs over the rows behind m, from its moments."""
    b = model.coefficients(a)
    off = model.y_mean - model.x_mean @ b
    design = np.vstack([-b, np.eye(len(off))])  # error = y - x b - off
    s = m.total @ design
    return np.diag(design.T @ m.cross @ design) - 2 * off * s + m.n * off**2


def with_targets(spectra: DataFrame, classes: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Adds y, one column per class (two classes: two columns)."""
    classes = classes or sorted(r[0] for r in spectra.select("label").where("label is not null").distinct().collect())
    return spectra.withColumn("y", one_hot("label", classes)), classes


def lv_curve(folded: DataFrame, p: int, most: int) -> list[tuple[int, float, float]]:
    """(components, rmsecv over all target cells, q2) from one pass: the model of a fold is fitted on the
    total minus the fold, and its errors come from the fold's own moments."""
    by_fold = moments(folded, "fold")
    total = sum(list(by_fold.values())[1:], next(iter(by_fold.values())))
    k = len(total.total) - p
    press = np.zeros(most)
    for m in by_fold.values():
        model = fit_pls(total - m, p, most)
        for a in range(most):
            press[a] += error_sum(model, min(a + 1, model.w.shape[1]), m, p).sum()
    _, c = total.centred()
    ss = np.trace(c[p:, p:])
    return [(a + 1, float(np.sqrt(press[a] / (total.n * k))), float(1 - press[a] / ss)) for a in range(most)]


def choose_lv(curve: list[tuple[int, float, float]], slack: float = 0.02) -> int:
    """The fewest components whose error is within the slack of the least."""
    best = min(c[1] for c in curve)
    return next(a for a, e, _ in curve if e <= (1 + slack) * best)


def out_of_fold(folded: DataFrame, classes: list[str], p: int, a: int) -> DataFrame:
    """sample_id, label, fold, predicted, scores: every row scored by the model of the other folds. The
    fold models are literals in one expression, so scoring is a scan."""
    by_fold = moments(folded, "fold")
    total = sum(list(by_fold.values())[1:], next(iter(by_fold.values())))
    scores = F.lit(None).cast("array<double>")
    for k, m in by_fold.items():
        scores = F.when(F.col("fold").cast("string") == k, fit_pls(total - m, p, a).predict(F.col("x"), a)).otherwise(scores)
    out = folded.withColumn("scores", scores)
    return out.select("sample_id", "label", "fold", predicted_class("scores", classes).alias("predicted"), "scores")


def predicted_class(scores: str, classes: list[str]) -> Column:
    best = F.array_max(F.transform(scores, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    return F.get(F.lit(classes), -best["i"])


def vip(model: Pls, a: int) -> np.ndarray:
    ss = model.t_ss[:a] * (model.q[:, :a] ** 2).sum(0)
    return np.sqrt(len(model.w) * ((model.w[:, :a] ** 2) * ss).sum(1) / (ss.sum() + 1e-12))


def selectivity_ratio(model: Pls, a: int, m: Moments, p: int) -> np.ndarray:
    """Explained over residual variance of the target projection on each output's coefficients; the
    largest over outputs."""
    _, c = m.centred()
    xx = c[:p, :p]
    best = np.zeros(p)
    for b in model.coefficients(a).T:
        norm = np.linalg.norm(b)
        if norm < 1e-15:
            continue
        u = b / norm
        tt = u @ xx @ u
        load = xx @ u / tt
        explained = tt * load**2 / (m.n - 1)
        residual = np.maximum(np.diag(xx) / (m.n - 1) - explained, 1e-12)
        best = np.maximum(best, explained / residual)
    return best


@dataclass
class Pca:
    mean: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray
    total: float

    def scores(self, x: Column) -> Column:
        return R.products(x, self.loadings, -(self.mean @ self.loadings))

    def t2(self, x: Column) -> Column:
        t = self.scores(x)
        return R.total(F.zip_with(t, R.constants(np.where(self.variance > 0, self.variance, 1.0)), lambda a, b: a * a / b))

    def q(self, x: Column) -> Column:
        """Squared distance to the model plane: |x - mean|^2 - |t|^2."""
        centred = F.zip_with(x, R.constants(self.mean), lambda a, b: a - b)
        return F.greatest(R.dot(centred, centred) - R.total(F.transform(self.scores(x), lambda t: t * t)), F.lit(0.0))


def fit_pca(m: Moments, p: int, components: int) -> Pca:
    mean, c = m.centred()
    values, vectors = np.linalg.eigh(c[:p, :p] / max(m.n - 1, 1))
    order = np.argsort(values)[::-1][: min(components, p, max(int(m.n) - 1, 1))]
    v = vectors[:, order]
    v = v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])])
    return Pca(mean[:p], v, np.maximum(values[order], 0), float(values.sum()))


def ward(points: dict[str, np.ndarray]) -> list[tuple[str, str, float]]:
    """Merges of Ward's linkage over class centroids (few): (left, right, height)."""
    alive = {k: (np.asarray(v, float), 1) for k, v in points.items()}
    merges = []
    while len(alive) > 1:
        names = sorted(alive)
        cost = {(a, b): np.sqrt(2 * alive[a][1] * alive[b][1] / (alive[a][1] + alive[b][1])) * np.linalg.norm(alive[a][0] - alive[b][0]) for i, a in enumerate(names) for b in names[i + 1 :]}
        a, b = min(cost, key=lambda k: (round(cost[k], 12), k))
        (u, n), (v, m) = alive.pop(a), alive.pop(b)
        alive[f"({a} {b})"] = ((n * u + m * v) / (n + m), n + m)
        merges.append((a, b, float(cost[(a, b)])))
    return merges
