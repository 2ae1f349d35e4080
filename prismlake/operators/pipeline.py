"""Preprocessing inside cross-validation: a fold's model, and the rows it is judged on, know the state of the
training folds only.

A learned step (MSC's reference, means, deviations) comes from sums by fold: what fold f may know is the total
minus its own. Rows are transformed inside the tasks that add the moments, each by the state of every fold it
trains and of the one it tests, so no transformed table is written. Trailing centring and autoscaling need no
state at all: they are linear, and come from the training moments themselves.

Rows without x, label or fold don't count; of different lengths they fail; a table without rows is a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import rowlocal as R
from prismlake.operators.gram import Moments, added, channels, matrix, moments
from prismlake.operators.latent import Pls, error_sum, fit_pls, predicted_class

ROW_LOCAL, LEARNED = ("snv", "l2", "savgol"), ("msc", "center", "autoscale")
#: One state of a learned step: (mean spectrum, deviations).
State = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Steps:
    """The steps of a preprocessing, in order, and the filter of its savgol steps."""

    names: tuple[str, ...]
    window: int = 25
    poly: int = 2
    deriv: int = 1

    def __post_init__(self):
        if unknown := [n for n in self.names if n not in ROW_LOCAL + LEARNED]:
            raise ValueError(f"unknown steps {unknown}; known: {', '.join(ROW_LOCAL + LEARNED)}")

    @property
    def inner(self) -> tuple[str, ...]:
        """The steps before trailing linear ones."""
        names = list(self.names)
        while names and names[-1] in ("center", "autoscale"):
            names.pop()
        return tuple(names)

    @property
    def scaled(self) -> bool:
        """Whether channels are divided by their deviations at the end. (After that, more of it changes nothing.)"""
        return "autoscale" in self.names[len(self.inner) :]

    def apply(self, x: np.ndarray, states: list[State], upto: int | None = None) -> np.ndarray:
        """Rows of x after the inner steps (or the first `upto`); learned ones take their states in order."""
        known = iter(states)
        for name in self.inner[:upto]:
            if name == "snv":
                s = x.std(1, keepdims=True)
                x = (x - x.mean(1, keepdims=True)) / np.where(s == 0, 1.0, s)
            elif name == "l2":
                n = np.sqrt((x * x).sum(1, keepdims=True))
                x = x / np.where(n == 0, 1.0, n)
            elif name == "savgol":
                x = _filtered(x, R.savgol_weights(self.window, self.poly, self.deriv))
            elif name == "msc":
                x = _scatter_corrected(x, next(known)[0])
            else:
                mean, sd = next(known)
                x = x - mean if name == "center" else (x - mean) / np.where(sd == 0, 1.0, sd)
        return x


def _filtered(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w, p = len(weights), x.shape[1]
    if p < w:
        raise ValueError(f"a window of {w} channels, and spectra of {p}")
    h = w // 2
    inner = np.lib.stride_tricks.sliding_window_view(x, w, axis=1) @ weights[h]
    return np.hstack([x[:, :w] @ weights[:h].T, inner, x[:, p - w :] @ weights[h + 1 :].T])


def _scatter_corrected(x: np.ndarray, reference: np.ndarray) -> np.ndarray:
    r, mean = reference - reference.mean(), x.mean(1, keepdims=True)
    var = (r * r).mean()
    if var < 1e-12:
        return x - mean
    b = ((x - mean) @ r / len(r) / var)[:, None]
    a = mean - b * reference.mean()
    return (x - a) / np.where(np.abs(b) <= 1e-12, 1.0, b)


def _fits(folded: DataFrame, steps: Steps) -> None:
    """A window wider than the spectra is an error, before any pass."""
    if "savgol" in steps.inner and (p := channels(folded)) < steps.window:
        raise ValueError(f"a window of {steps.window} channels, and spectra of {p}")


def learned_states(folded: DataFrame, steps: Steps) -> dict[str, list[State]]:
    """By fold, the states that its training rows teach the inner learned steps: a pass for each of these."""
    _fits(folded, steps)
    rows = folded.select(F.col("fold").cast("string").alias("fold"), "x").where("fold is not null and x is not null")
    states: dict[str, list[State]] = {}
    for at, name in enumerate(steps.inner):
        if name not in LEARNED:
            continue
        known = dict(states)

        def add(batches: Iterator[pa.RecordBatch], at=at, known=known) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, str], np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                g, x = np.array(b.column(0).to_pylist(), object), matrix(b.column(1))
                for f in known or [""]:  # before any state, all folds see the same rows
                    z = steps.apply(x, known.get(f, []), at)
                    for k in sorted(set(g.tolist())):
                        part = z[g == k]
                        sums[f, k] = sums.get((f, k), 0) + np.concatenate([[len(part)], part.sum(0), (part * part).sum(0)])
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["state", "fold", "row"])

        schema = "state string, fold string, row array<double>"
        got = {(r["state"], r["fold"]): np.array(r["row"]) for r in added(rows.mapInArrow(add, schema), ["state", "fold"], schema).collect()}
        folds = sorted({k for _, k in got})
        for f in folds:
            train = sum(v for (s, k), v in got.items() if s in ("", f) and k != f)
            if np.ndim(train) == 0 or train[0] == 0:
                raise ValueError(f"fold {f} leaves no training rows")
            n, p = train[0], (len(train) - 1) // 2
            mean = train[1 : p + 1] / n
            states.setdefault(f, []).append((mean, np.sqrt(np.maximum(train[p + 1 :] / n - mean * mean, 0))))
    return states


@dataclass
class Fold:
    """Moments of [x, y] of the rows that a fold trains on and tests, both transformed by its own states, and the
    deviations of the training rows where channels are scaled."""

    train: Moments
    test: Moments
    scale: np.ndarray | None = None


def _rescaled(m: Moments, scale: np.ndarray) -> Moments:
    f = np.concatenate([1 / scale, np.ones(len(m.total) - len(scale))])
    return Moments(m.n, m.total * f, m.cross * np.outer(f, f))


def fold_moments(folded: DataFrame, steps: Steps, states: dict[str, list[State]] | None = None) -> dict[str, Fold]:
    """By fold, what its model is fitted on and judged by (folded: fold, x, y)."""
    states = learned_states(folded, steps) if states is None else states

    def by_state(g: np.ndarray, x: np.ndarray):
        for f, known in states.items():
            z = steps.apply(x, known)
            for name, on in (("train", g != f), ("test", g == f)):
                if on.any():
                    yield f"{name} {f}", on, z[on]

    def by_fold(g: np.ndarray, x: np.ndarray):
        z = steps.apply(x, [])
        for k in sorted(set(g.tolist())):
            yield k, g == k, z[g == k]

    sums = moments(folded, "fold", expand=by_state if states else by_fold)
    if not sums:
        raise ValueError("no row with a spectrum")
    if states:
        out = {f: Fold(sums[f"train {f}"], sums[f"test {f}"]) for f in states}
    else:
        total = sum(list(sums.values())[1:], next(iter(sums.values())))
        out = {f: Fold(total - m, m) for f, m in sums.items()}
    if steps.scaled:
        for f, fold in out.items():
            k = len(folded.select("y").first()[0])
            mean = fold.train.total / fold.train.n
            sd = np.sqrt(np.maximum(np.diag(fold.train.cross) / fold.train.n - mean * mean, 0))[: len(mean) - k]
            scale = np.where(sd <= 1e-12 * np.maximum(np.abs(mean[: len(sd)]), 1), 1.0, sd)
            out[f] = Fold(_rescaled(fold.train, scale), _rescaled(fold.test, scale), scale)
    return out


def curve(parts: dict[str, Fold], targets: int, most: int) -> list[tuple[int, float, float]]:
    """(components, rmsecv over all target cells, q2) of models that see their training folds only."""
    press = np.zeros(most)
    total = sum((f.test for f in list(parts.values())[1:]), next(iter(parts.values())).test)
    p = len(total.total) - targets
    for f in parts.values():
        model = fit_pls(f.train, p, most)
        for a in range(most):
            press[a] += error_sum(model, min(a + 1, model.w.shape[1]), f.test, p).sum()
    ss = np.trace(total.centred()[1][p:, p:])
    return [(a + 1, float(np.sqrt(press[a] / (total.n * targets))), float(1 - press[a] / ss)) for a in range(most)]


def out_of_fold(folded: DataFrame, classes: list[str], steps: Steps, components: int, states: dict[str, list[State]] | None = None, parts: dict[str, Fold] | None = None) -> DataFrame:
    """sample_id, label, fold, predicted, scores: every row transformed by the states of its fold and scored by
    its model. States and models, a few spectra for each fold, go to the tasks."""
    states = learned_states(folded, steps) if states is None else states
    parts = fold_moments(folded, steps, states) if parts is None else parts
    models: dict[str, np.ndarray] = {}
    for f, fold in parts.items():
        p = len(fold.train.total) - len(classes)
        m: Pls = fit_pls(fold.train, p, components)
        b = m.coefficients(m.w.shape[1])
        b = b if fold.scale is None else b / fold.scale[:, None]
        models[f] = np.vstack([m.y_mean - (m.x_mean if fold.scale is None else m.x_mean * fold.scale) @ b, b])
    shared = folded.sparkSession.sparkContext.broadcast((states, models))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fitted = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            g, x = np.array(b.column(2).to_pylist(), object), matrix(b.column(3))
            out = np.full((len(g), len(classes)), np.nan)
            for f in set(g.tolist()):
                z = steps.apply(x[g == f], known.get(f, []))
                out[g == f] = fitted[f][0] + z @ fitted[f][1:]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(out), pa.list_(pa.float64()))], ["sample_id", "label", "fold", "scores"])

    rows = folded.select("sample_id", "label", F.col("fold").cast("string").alias("fold"), "x").where("fold is not null and x is not null and label is not null")
    kind = dict(folded.dtypes)["sample_id"]
    scored = rows.mapInArrow(score, f"sample_id {kind}, label string, fold string, scores array<double>")
    return scored.select("sample_id", "label", F.col("fold").cast(dict(folded.dtypes)["fold"]).alias("fold"), predicted_class("scores", classes).alias("predicted"), "scores")
