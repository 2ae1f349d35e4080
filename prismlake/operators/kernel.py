"""Kernel machines at any number of rows: random Fourier features of the Gaussian kernel, and support-vector
classification and regression with squared losses on them, fitted by Newton steps from sums.

Squared hinge and squared insensitive loss are least squares over the rows that are active at the present
weights, so a Newton step needs their cross products only, as in gram.moments: one pass over the data gives the
step of all folds and all classes at once, and no row leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.operators.gram import Moments, added, matrix


@dataclass
class Fourier:
    """cos and sin of random projections: their products are exp(-gamma |x - y|^2), but for an error whose standard
    deviation is 1 / sqrt(features) at most."""

    mean: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, gamma: float, features: int = 256, seed: int = 42) -> Fourier:
        rng = np.random.default_rng(seed)
        return cls(mean, rng.normal(size=(len(mean), max(features // 2, 1))) * np.sqrt(2 * gamma))

    def apply(self, x: np.ndarray) -> np.ndarray:
        t = (x - self.mean) @ self.w
        return np.hstack([np.cos(t), np.sin(t)]) / np.sqrt(self.w.shape[1])

    def transform(self, rows: DataFrame, x: str = "x", out: str = "features") -> DataFrame:
        """rows with the features as an array column; null where x is."""
        names = [c for c in rows.columns if c != out]
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                column = b.column(names.index(x))
                on = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                got: list = [None] * b.num_rows
                for i, z in zip(on, shared.value.apply(matrix(column.take(pa.array(on)))) if len(on) else [], strict=True):
                    got[i] = z
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.float64()))], [*names, out])

        return rows.select(*names).mapInArrow(run, rows.select(*names).withColumn(out, F.lit(None).cast("array<double>")).schema)


def scale_gamma(m: Moments, p: int) -> float:
    """1 / (p times the variance of all cells of x); 1 for constant data."""
    cells = m.n * p
    var = np.trace(m.cross[:p, :p]) / cells - (m.total[:p].sum() / cells) ** 2
    return 1.0 / (p * var) if var > 1e-300 else 1.0


@dataclass
class Problem:
    """One machine: its training folds (all but `fold`), its target column, and its weights so far."""

    fold: int | None
    target: int
    weights: np.ndarray
    step: np.ndarray
    objective: float = np.inf
    size: float = 1.0
    done: bool = False


def newton(rows: DataFrame, features: Fourier, folds: list[int | None], targets: int, epsilon: float | None, cost: float = 1.0, most: int = 25) -> dict[tuple[int | None, int], np.ndarray]:
    """Weights (intercept first) by (left-out fold, target): |w|^2 / 2 + cost times the sum of squared losses.

    rows: fold, x, y. Without epsilon, targets are -1 and 1 under the squared hinge; with it, numbers under the
    squared epsilon-insensitive loss. A step that makes things worse is halved. Left-out fold None: all rows."""
    spark = rows.sparkSession
    size = 2 * features.w.shape[1] + 1
    problems = [Problem(f, k, np.zeros(size), np.zeros(size)) for f in folds for k in range(targets)]
    data = rows.select(F.col("fold").cast("int").alias("fold"), "x", "y").where("x is not null and y is not null")
    ridge = np.diag([1e-8] + [1.0] * (size - 1))
    for _ in range(most):
        open_ = [p for p in problems if not p.done]
        if not open_:
            break
        shared = spark.sparkContext.broadcast((features, [(p.fold, p.target, p.weights + p.size * p.step) for p in open_]))

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            fourier, at = shared.value
            sums: list = [None] * len(at)
            for b in batches:
                if not b.num_rows:
                    continue
                fold, y = b.column(0).to_numpy(), matrix(b.column(2))
                z = np.hstack([np.ones((b.num_rows, 1)), fourier.apply(matrix(b.column(1)))])
                for i, (f, k, w) in enumerate(at):
                    on = np.ones(len(z), bool) if f is None else fold != f
                    got, want = z[on] @ w, y[on, k]
                    if epsilon is None:
                        active, want = want * got < 1, want
                    else:
                        active, want = np.abs(want - got) > epsilon, want - epsilon * np.sign(want - got)
                    za, ta = z[on][active], want[active]
                    part = np.concatenate([[((got[active] - ta) ** 2).sum()], za.T @ ta, (za.T @ za).ravel()])
                    sums[i] = part if sums[i] is None else sums[i] + part
            rows_ = [(i, s) for i, s in enumerate(sums) if s is not None]
            if rows_:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows_], pa.int32()), pa.array([s for _, s in rows_], pa.list_(pa.float64()))], ["i", "row"])

        schema = "i int, row array<double>"
        got = {r["i"]: np.array(r["row"]) for r in added(data.mapInArrow(add, schema), ["i"], schema).collect()}
        for i, p in enumerate(open_):
            if i not in got:
                p.done = True
                continue
            w = p.weights + p.size * p.step
            objective = float(w[1:] @ w[1:]) / 2 + cost * got[i][0]
            if objective > p.objective * (1 + 1e-10) and p.size > 1e-3:
                p.size /= 2
                continue
            p.done = p.objective - objective <= 1e-9 * max(abs(objective), 1)
            p.weights, p.objective, p.size = w, objective, 1.0
            h = 2 * cost * got[i][size + 1 :].reshape(size, size) + ridge
            p.step = np.linalg.solve(h, 2 * cost * got[i][1 : size + 1]) - w
    return {(p.fold, p.target): p.weights for p in problems}


def scores(rows: DataFrame, features: Fourier, weights: dict[tuple[int | None, int], np.ndarray], targets: int) -> DataFrame:
    """rows with `scores` (array): by the machines that leave out the row's fold, or else by those of all rows."""
    names = [c for c in rows.columns if c != "scores"]
    shared = rows.sparkSession.sparkContext.broadcast((features, weights))
    whole = all(f is None for f, _ in weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fourier, known = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            z = np.hstack([np.ones((b.num_rows, 1)), fourier.apply(matrix(b.column(names.index("x"))))])
            out = np.zeros((b.num_rows, targets))
            if whole:
                out = z @ np.stack([known[None, k] for k in range(targets)], 1)
            else:
                fold = b.column(names.index("fold")).to_numpy()
                for f in np.unique(fold):
                    out[fold == f] = z[fold == f] @ np.stack([known[int(f), k] for k in range(targets)], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), pa.list_(pa.float64()))], [*names, "scores"])

    kept = rows.select(*names).where("x is not null")
    return kept.mapInArrow(run, kept.withColumn("scores", F.array(F.lit(0.0))).schema)
