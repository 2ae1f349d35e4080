"""Diagnostics of latent-variable models: distances to the model, limits, applicability, contributions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions import quantiles
from prismlake.functions import rowlocal as R
from prismlake.operators.gram import Moments, channels, matrix, moments
from prismlake.operators.latent import Pca, Pls, error_sum, fit_pca, fit_pls
from prismlake.schema import to_long


def whole(spectra: DataFrame, y: Column | None = None) -> Moments:
    """Moments of all rows, with y (an array column) or without targets."""
    rows = spectra.withColumn("y", F.array(F.lit(0.0)) if y is None else y).withColumn("all", F.lit("all"))
    return moments(rows, "all")["all"]


def explained_variance(model: Pls, m: Moments, p: int) -> np.ndarray:
    """Percent of the variance of x that each component's scores have (population variances)."""
    _, c = m.centred()
    return 100 * model.t_ss / np.trace(c[:p, :p])


def model_metrics(model: Pls, a: int, m: Moments, p: int, press: float | None = None) -> dict[str, float]:
    """R2X, R2Y of the fitted model and, given the cross-validated error sum, Q2."""
    _, c = m.centred()
    ssx, ssy = np.trace(c[:p, :p]), np.trace(c[p:, p:])
    out = {"r2x": float((model.t_ss[:a] * (model.p[:, :a] ** 2).sum(0)).sum() / ssx), "r2y": float(1 - error_sum(model, a, m, p).sum() / ssy)}
    return out | ({} if press is None else {"q2": float(1 - press / ssy)})


def x_residual(model: Pls, x: Column, a: int) -> Column:
    """Squared distance of centred x to its reconstruction from a components."""
    c = F.zip_with(x, R.constants(model.x_mean), lambda u, v: u - v)
    t = model.scores(x, a)
    cross = sum((F.get(t, F.lit(k)) * R.dot(c, R.constants(model.p[:, k])) for k in range(a)), F.lit(0.0))
    square = sum((F.get(t, F.lit(i)) * F.get(t, F.lit(j)) * float(model.p[:, i] @ model.p[:, j]) for i in range(a) for j in range(a)), F.lit(0.0))
    return F.greatest(R.dot(c, c) - 2 * cross + square, F.lit(0.0))


def dmodx(rows: DataFrame, q: str, variables: int, components: int) -> DataFrame:
    """rows with dmodx: sqrt(Q / (K - A)) over its residual deviation s0, of N rows; s0 under 1e-12 is 1."""
    free = max(variables - components, 1)
    sums = rows.agg(F.sum(q).alias("_q"), F.count("*").alias("_n"))
    s0 = F.sqrt(F.col("_q") / F.greatest((F.col("_n") - components - 1) * free, F.lit(1)))
    out = rows.crossJoin(F.broadcast(sums)).withColumn("_s", F.when(s0 > 1e-12, s0).otherwise(1.0))
    return out.withColumn("dmodx", F.sqrt(F.col(q) / free) / F.col("_s")).drop("_q", "_n", "_s")


def dmodx_limit(spark: SparkSession, variables: int, components: int, n: int, alpha: float = 0.05) -> float:
    free = max(variables - components, 1)
    return float(np.sqrt(quantiles.f(spark, 1 - alpha, free, max((n - components - 1) * free, 1))))


def dmody(rows: DataFrame, residual: Column, components: int) -> DataFrame:
    """rows with dmody: |y - predicted| over sqrt(sum of squares / (N - A - 1))."""
    sums = rows.agg(F.sum(residual * residual).alias("_r"), F.count("*").alias("_n"))
    s0 = F.sqrt(F.col("_r") / F.greatest(F.col("_n") - components - 1, F.lit(1)))
    out = rows.crossJoin(F.broadcast(sums)).withColumn("_s", F.when(s0 > 1e-12, s0).otherwise(1.0))
    return out.withColumn("dmody", F.abs(residual) / F.col("_s")).drop("_r", "_n", "_s")


def dmody_limit(spark: SparkSession, components: int, n: int, alpha: float = 0.05) -> float:
    return float(np.sqrt(quantiles.f(spark, 1 - alpha, 1, max(n - components - 1, 1))))


def q_limit(spark: SparkSession, rows: DataFrame, q: str, alpha: float = 0.05) -> float:
    """g chi2(1 - alpha; h) with g = var / 2m, h = 2m^2 / var (population variance). No rows: 0; no variance:
    the percentile."""
    r = rows.agg(F.avg(q).alias("m"), F.var_pop(q).alias("v"), F.percentile(q, 1 - alpha).alias("p")).first()
    if r["m"] is None:
        return 0.0
    if r["v"] <= 0 or r["m"] <= 0:
        return float(r["p"])
    return float(r["v"] / (2 * r["m"]) * quantiles.chi2(spark, 1 - alpha, 2 * r["m"] ** 2 / r["v"]))


@dataclass
class Spectrum:
    """The eigenvalues (descending) and eigenvectors of the centred cross products of n rows."""

    n: float
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, m: Moments, p: int) -> Spectrum:
        mean, c = m.centred()
        values, vectors = np.linalg.eigh(c[:p, :p])
        return cls(m.n, mean[:p], np.maximum(values[::-1], 0.0), np.ascontiguousarray(vectors[:, ::-1]))


def loo_residuals(s: Spectrum, x: np.ndarray, components: int) -> np.ndarray:
    """Squared distance of each row of x to the plane fitted on the rows behind s without it; NaN where too few
    are left.

    Taking out a row takes rho d d' (d: the row less the mean, rho = n / (n - 1)) from the cross products. With
    z = U'd, the new eigenvalues are the roots of 1 = rho sum z_i^2 / (l_i - mu), one between each two of the old
    ones, and d's projection on the new direction has the square 1 / (rho^2 sum z_i^2 / (l_i - mu)^2). So a row
    costs its product with U and a bisection for each component, not a decomposition."""
    out = np.full(len(x), np.nan)
    a = min(components, int(s.n) - 2, x.shape[1])
    if s.n < 3 or a < 1:
        return out
    rho = s.n / (s.n - 1)
    top = max(float(s.values[0]), 1e-300)
    for begin in range(0, len(x), 256):
        d = x[begin : begin + 256] - s.mean
        z2 = (d @ s.vectors) ** 2
        gone = np.zeros(len(d))
        for k in range(a):
            hi, lo = s.values[k], s.values[k + 1] if k + 1 < len(s.values) else min(0.0, s.values[k] - top)
            if hi - lo <= 1e-15 * top:
                continue  # a repeated eigenvalue stays, in a direction without d
            # the root is measured from the nearer end, so that the difference to it keeps its digits
            near_hi = 1 - rho * (z2 / (s.values - (hi + lo) / 2)).sum(1) > 0
            delta = s.values[None, :] - np.where(near_hi, hi, lo)[:, None]
            left, right = np.where(near_hi, -(hi - lo) / 2, 0.0), np.where(near_hi, 0.0, (hi - lo) / 2)
            for _ in range(64):
                mid = (left + right) / 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    above = 1 - rho * np.nansum(z2 / (delta - mid[:, None]), 1) > 0
                left, right = np.where(above, mid, left), np.where(above, right, mid)
            with np.errstate(divide="ignore", invalid="ignore"):
                slope = np.nansum(z2 / (delta - ((left + right) / 2)[:, None]) ** 2, 1)
                # a bracket that still touches its end: the old direction stays, and d has no part in it
                inside = np.where(near_hi, right < 0, left > 0) & np.isfinite(slope) & (slope > 0)
                gone += np.where(inside, 1 / (rho * rho * slope), 0.0)
        out[begin : begin + 256] = rho * rho * np.maximum((d * d).sum(1) - gone, 0.0)
    return out


def loo_q(spectra: DataFrame, by: str, classes: dict[str, Moments], components: int) -> DataFrame:
    """spectra with q_loo: the squared distance of each row to the plane fitted on its class without it.

    The classes' eigenvectors, p x p numbers each, are found once and go to the tasks; a row is taken out by a
    rank-one downdate (loo_residuals), and no task holds a class. Null where fewer than three rows are left, for a
    null x and for a class without moments."""
    p = max((len(m.total) for m in classes.values()), default=1) - 1
    shared = spectra.sparkSession.sparkContext.broadcast({k: Spectrum.of(m, p) for k, m in classes.items()})
    names = [c for c in spectra.columns if c != "q_loo"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array([str(k) for k in b.column(names.index(by)).to_pylist()], object)
            column = b.column(names.index("x"))
            out = np.full(b.num_rows, np.nan)
            known = np.array([k in shared.value for k in keys], bool) & column.is_valid().to_numpy(zero_copy_only=False)
            for k in set(keys[known].tolist()):
                on = np.flatnonzero(known & (keys == k))
                out[on] = loo_residuals(shared.value[k], matrix(column.take(pa.array(on)), p), components)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64(), mask=np.isnan(out))], [*names, "q_loo"])

    schema = spectra.select(*names).withColumn("q_loo", F.lit(None).cast("double")).schema
    return spectra.select(*names).mapInArrow(judge, schema)


def moments_dof(mean: float | None, sd: float | None) -> float:
    """2 (mean / sd)^2; 1 where that can't be had."""
    return 2 * (mean / sd) ** 2 if mean and sd and mean > 0 and sd > 0 else 1.0


@dataclass
class Domain:
    """What new samples need: plane, score variances, and the scale and freedom of both distances."""

    pca: Pca
    h0: float
    q0: float
    nh: float
    nq: float
    limit: float
    t2_limit: float
    q_limit: float

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with t2, q, distance, inside: row-local."""
        out = rows.withColumn("t2", self.pca.t2(F.col("x"))).withColumn("q", self.pca.q(F.col("x")))
        return out.withColumn("distance", F.col("t2") / max(self.h0, 1e-12) * self.nh + F.col("q") / max(self.q0, 1e-12) * self.nq).withColumn("inside", F.col("distance") <= self.limit)


def applicability(spectra: DataFrame, components: int, alpha: float = 0.05) -> Domain:
    """The applicability domain of a training set: combined distance of T2 and of leave-one-out Q, with scale
    and degrees of freedom by moments. The limits of one axis are for plots only."""
    spark = spectra.sparkSession
    p = channels(spectra)
    m = whole(spectra)
    pca = fit_pca(m, p, components)
    judged = loo_q(spectra.select("x").withColumn("all", F.lit("all")), "all", {"all": m}, pca.loadings.shape[1]).select(pca.t2(F.col("x")).alias("t2"), F.col("q_loo"))
    r = judged.agg(F.avg("t2").alias("h0"), F.stddev_samp("t2").alias("hs"), F.avg("q_loo").alias("q0"), F.stddev_samp("q_loo").alias("qs")).first()
    nh, nq = moments_dof(r["h0"], r["hs"]), moments_dof(r["q0"], r["qs"])
    return Domain(pca, r["h0"], r["q0"] or 0.0, nh, nq, quantiles.chi2(spark, 1 - alpha, nh + nq), quantiles.hotelling_limit(spark, int(m.n), pca.loadings.shape[1], alpha), q_limit(spark, judged, "q_loo", alpha))


def mad_outliers(rows: DataFrame, columns: list[str], *keys: str, limit: float = 3.5) -> DataFrame:
    """rows with `flagged`: a robust score 0.6745 (v - median) / MAD beyond the limit on any of the columns.
    Flags are for reading; no row is taken out by them. A MAD of 0 flags nothing."""
    med = rows.groupBy(*keys).agg(*(F.percentile(c, 0.5).alias(f"_m_{c}") for c in columns))
    joined = rows.join(med, list(keys)) if keys else rows.crossJoin(F.broadcast(med))
    mad = joined.groupBy(*keys).agg(*(F.percentile(F.abs(F.col(c) - F.col(f"_m_{c}")), 0.5).alias(f"_d_{c}") for c in columns))
    joined = joined.join(mad, list(keys)) if keys else joined.crossJoin(F.broadcast(mad))
    flag = F.lit(False)
    for c in columns:
        flag = flag | F.coalesce((F.col(f"_d_{c}") > 0) & (0.6745 * F.abs(F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}") > limit), F.lit(False))
    return joined.withColumn("flagged", flag).drop(*(f"_{k}_{c}" for k in "md" for c in columns))


def score_contributions(spectra: DataFrame, weights: np.ndarray) -> DataFrame:
    """label, j, mean, se of x_j w_j / |w| in each class."""
    w = weights / (np.linalg.norm(weights) or 1.0)
    long = to_long(spectra.select("label", F.zip_with("x", R.constants(w), lambda a, b: a * b).alias("x")))
    return long.groupBy("label", "j").agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("se"))


def discriminant_power(contributions: DataFrame) -> DataFrame:
    """j, power: the population variance of the class means of a channel's contribution."""
    return contributions.groupBy("j").agg(F.var_pop("mean").alias("power"))


def top(rows: DataFrame, value: str, n: int, *order: str) -> DataFrame:
    """The n rows of the greatest value; ties in the given order."""
    return rows.orderBy(F.desc(value), *order).limit(n)


def distinct_peaks(values: np.ndarray, wn: np.ndarray, n: int, apart: float, floor: float = 0.15) -> list[int]:
    """Channels of the largest magnitudes, each `apart` axis units or more from those before, down to a share
    `floor` of the largest."""
    size = np.abs(values)
    chosen: list[int] = []
    for j in np.lexsort((np.arange(len(size)), -size)):
        if len(chosen) == n or size[j] < floor * size.max():
            break
        if all(abs(wn[j] - wn[k]) >= apart for k in chosen):
            chosen.append(int(j))
    return chosen


def ellipse(scores: DataFrame, a: str, b: str, *keys: str, chi2: float = 5.991464547107979) -> DataFrame:
    """Centre, half axes, angle (degrees) of the 95 % covariance ellipse of two scores; null under four
    points, with a flat covariance, or beyond an axis ratio of 50."""
    g = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(a).alias("centre_a"), F.avg(b).alias("centre_b"), F.var_samp(a).alias("_a"), F.var_samp(b).alias("_b"), F.covar_samp(a, b).alias("_c"))
    half, root = (F.col("_a") + F.col("_b")) / 2, F.sqrt(F.pow((F.col("_a") - F.col("_b")) / 2, 2) + F.pow("_c", 2))
    g = g.withColumn("_hi", half + root).withColumn("_lo", half - root)
    good = (F.col("n") >= 4) & (F.col("_lo") > 0) & (F.sqrt(F.col("_hi") / F.col("_lo")) <= 50)
    put = lambda c: F.when(good, c)
    return g.select(*keys, "n", "centre_a", "centre_b", put(F.sqrt(F.col("_hi") * chi2)).alias("major"), put(F.sqrt(F.col("_lo") * chi2)).alias("minor"), put(F.degrees(F.atan2(F.col("_hi") - F.col("_a"), F.col("_c")))).alias("angle"))


def cooman(distances: DataFrame, a: str, b: str) -> DataFrame:
    """sample_id, label, x, y: distances to two class models over their limits. distances: sample_id, label,
    model, q, q_limit."""
    d = lambda m: F.max(F.when(F.col("model") == m, F.sqrt(F.greatest(F.col("q") / F.col("q_limit"), F.lit(0.0)))))
    return distances.where(F.col("model").isin(a, b)).groupBy("sample_id", "label").agg(d(a).alias("x"), d(b).alias("y"))


def outlier_union(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows beyond the limit of any of the columns, each once."""
    beyond = F.lit(False)
    for c, v in limits.items():
        beyond = beyond | (F.col(c) > v)
    return rows.where(beyond)


def outlier_shares(rows: DataFrame, value: str, limit: float, worst: float = 0.30) -> DataFrame:
    """label, share, many: the share of a class's rows beyond a limit, and whether it is over the worst."""
    g = rows.groupBy("label").agg(F.avg((F.col(value) > limit).cast("double")).alias("share"))
    return g.withColumn("many", F.col("share") > worst)


def class_pairs(classes: DataFrame, label: str = "label", most: int = 6) -> DataFrame:
    """The first pairs a < b of the classes, in order."""
    c = classes.select(label).distinct()
    return c.select(F.col(label).alias("a")).join(c.select(F.col(label).alias("b")), F.col("a") < F.col("b")).orderBy("a", "b").limit(most)


@dataclass
class Opls:
    """One predictive component after orthogonal deflation. weights: of the predictive score in centred x;
    orthogonal: of each orthogonal score."""

    mean: np.ndarray
    weights: np.ndarray
    orthogonal: np.ndarray
    loadings: np.ndarray

    def predictive(self, x: Column) -> Column:
        return R.dot(x, R.constants(self.weights)) - float(self.mean @ self.weights)

    def scores(self, x: Column) -> Column:
        return F.array(*(R.dot(x, R.constants(v)) - float(self.mean @ v) for v in self.orthogonal.T))


def fit_opls(m: Moments, p: int, orthogonal: int = 1) -> Opls:
    """Orthogonal projections to latent structures from moments alone.

    The target is y where it has one column; else the combination of its columns that the first component of
    PLS on all of them has. Each orthogonal score is what the loading of the predictive weight has outside of
    it, made orthogonal to the predictive score; x is deflated by it, y is not."""
    mean, c = m.centred()
    xx, xy = c[:p, :p].copy(), c[:p, p:].copy()
    if xy.shape[1] > 1:
        first = fit_pls(m, p, 1)
        target = first.q[:, 0] / max(float((first.q[:, 0] ** 2).sum()), 1e-300)
    else:
        target = np.ones(1)
    change = np.eye(p)  # deflated x = centred x @ change
    rotations, loadings = [], []
    for _ in range(orthogonal):
        w = xy @ target
        if np.linalg.norm(w) < 1e-12:
            break
        w = w / np.linalg.norm(w) * np.sign(w[np.argmax(np.abs(w))])
        tt = float(w @ xx @ w)
        if tt < 1e-12:
            break
        load = xx @ w / tt
        wo = load - (load @ w) * w
        if np.linalg.norm(wo) < 1e-10:
            break
        wo = wo / np.linalg.norm(wo)
        r = wo - float(wo @ xx @ w) / tt * w
        ss = float(r @ xx @ r)
        if ss < 1e-12:
            break
        po = xx @ r / ss
        rotations.append(change @ r)
        loadings.append(po)
        step = np.eye(p) - np.outer(r, po)
        xx, xy, change = step.T @ xx @ step, step.T @ xy, change @ step
    if xy.shape[1] == 1:
        w = xy[:, 0]
    else:
        w = xy @ np.linalg.eigh(xy.T @ xy)[1][:, -1]
    w = w / max(np.linalg.norm(w), 1e-300)
    w = w * (np.sign(w[np.argmax(np.abs(w))]) or 1.0)
    stack = lambda v: np.stack(v, 1) if v else np.zeros((p, 0))
    return Opls(mean[:p], change @ w, stack(rotations), stack(loadings))


def s_plot(scored: DataFrame, score: str) -> DataFrame:
    """j, covariance, correlation of each channel with a score; correlations stay within 1."""
    long = to_long(scored.select(F.col(score).alias("t"), "x"))
    corr = F.corr("v", "t")
    return long.groupBy("j").agg(F.covar_samp("v", "t").alias("covariance"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr)).alias("correlation"))
