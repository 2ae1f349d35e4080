"""Selection of channels from fold moments; balanced accuracies of all candidates come from one more pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.operators.gram import Moments, matrix, moments
from prismlake.operators.latent import error_sum, fit_pls, selectivity_ratio, vip

Choose = Callable[[dict, int, int], np.ndarray]


def _sum(by: dict) -> Moments:
    return sum(list(by.values())[1:], next(iter(by.values())))


def q2_of(by: dict, p: int, keep: np.ndarray, components: int) -> float:
    """Cross-validated q2 of a subset of channels; at least -1."""
    total = _sum(by)
    columns = np.concatenate([np.flatnonzero(keep), np.arange(p, len(total.total))])
    q = int(keep.sum())
    press = 0.0
    for m in by.values():
        model = fit_pls((total - m).subset(columns), q, min(components, q))
        press += error_sum(model, model.w.shape[1], m.subset(columns), q).sum()
    return float(max(-1.0, 1 - press / np.trace(total.centred()[1][p:, p:])))


def vip_mask(by: dict, p: int, components: int, least: float = 1.0) -> np.ndarray:
    model = fit_pls(_sum(by), p, components)
    return vip(model, model.w.shape[1]) >= least


def sr_mask(by: dict, p: int, components: int, share: float = 0.25) -> np.ndarray:
    """The max(2, round(share p)) channels of the greatest selectivity ratio; ties by the lower channel."""
    total = _sum(by)
    model = fit_pls(total, p, components)
    sr = selectivity_ratio(model, model.w.shape[1], total, p)
    keep = np.zeros(p, bool)
    keep[np.lexsort((np.arange(p), -sr))[: max(2, round(share * p))]] = True
    return keep


def interval_table(by: dict, p: int, components: int, intervals: int = 8) -> pd.DataFrame:
    """first, last, q2 of each interval of two channels or more."""
    edges = np.linspace(0, p, intervals + 1).astype(int)
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= 2:
            keep = np.zeros(p, bool)
            keep[a:b] = True
            rows.append((int(a), int(b - 1), q2_of(by, p, keep, components)))
    return pd.DataFrame(rows, columns=["first", "last", "q2"])


def interval_mask(by: dict, p: int, components: int, intervals: int = 8) -> np.ndarray:
    t = interval_table(by, p, components, intervals)
    best = t.sort_values(["q2", "first"], ascending=[False, True]).iloc[0]
    keep = np.zeros(p, bool)
    keep[int(best["first"]) : int(best["last"]) + 1] = True
    return keep


def sparse_mask(by: dict, p: int, components: int, keep_each: int | None = None) -> np.ndarray:
    """Sparse PLS-DA: each weight vector is shrunk by its (keep + 1)-th largest magnitude, which leaves `keep`
    channels, and x and y are deflated by the score of what is left. The union over components."""
    keep_each = max(1, min(p, keep_each or max(2, p // 8)))
    _, c = _sum(by).centred()
    xx, xy = c[:p, :p].copy(), c[:p, p:].copy()
    chosen = np.zeros(p, bool)
    for _ in range(max(1, min(components, p))):
        w = np.linalg.svd(xy, full_matrices=False)[0][:, 0]
        size = np.abs(w)
        cut = np.sort(size)[::-1][keep_each] if keep_each < p else 0.0
        w = np.sign(w) * np.maximum(size - cut, 0.0)
        norm = np.linalg.norm(w)
        if norm < 1e-12:
            break
        w /= norm
        tt = float(w @ xx @ w)
        if tt < 1e-12:
            break
        load = xx @ w / tt
        share = xy.T @ w / tt
        chosen |= w != 0
        step = np.eye(p) - np.outer(w, load)
        xx, xy = step.T @ xx @ step, step.T @ xy - np.outer(step.T @ (xx @ w), share)
    return chosen


def projection_chain(xx: np.ndarray, start: int, n: int) -> list[int]:
    """Successive projections: from a first channel, always the one with most left after the others'."""
    work = xx.copy()
    chain = [start]
    while len(chain) < n:
        k = chain[-1]
        work = work - np.outer(work[:, k], work[k]) / max(work[k, k], 1e-12)
        left = np.diag(work).copy()
        left[chain] = -np.inf
        chain.append(int(np.argmax(left)))
    return chain


def projection_mask(by: dict, p: int, components: int, n: int | None = None, starts: int = 8) -> np.ndarray:
    """The best chain, by q2, of those from evenly spaced first channels."""
    _, c = _sum(by).centred()
    best, score = np.ones(p, bool), -np.inf
    for s in np.unique(np.linspace(0, p - 1, min(starts, p)).astype(int)):
        keep = np.zeros(p, bool)
        keep[projection_chain(c[:p, :p], int(s), max(2, n or p // 8))] = True
        v = q2_of(by, p, keep, components)
        if v > score:
            best, score = keep, v
    return best


def genetic(by: dict, p: int, components: int, generations: int = 8, size: int = 12, seed: int = 3) -> tuple[np.ndarray, list[float]]:
    """(mask, best q2 by generation): tournaments of three, one cut, bit flips, the best always stays; two
    channels at least."""
    rng = np.random.default_rng(seed)
    population = [rng.random(p) < 0.5 for _ in range(size)]
    fitness = [q2_of(by, p, m, components) if m.sum() >= 2 else -1.0 for m in population]
    history = [max(fitness)]
    for _ in range(generations):
        children = [population[int(np.argmax(fitness))].copy()]
        while len(children) < size:
            a, b = (population[max(rng.integers(0, size, 3), key=lambda i: fitness[i])] for _ in range(2))
            cut = rng.integers(1, p)
            child = np.concatenate([a[:cut], b[cut:]]) ^ (rng.random(p) < 1 / p)
            children.append(child if child.sum() >= 2 else a.copy())
        population = children
        fitness = [q2_of(by, p, m, components) for m in population]
        history.append(max(fitness))
    return population[int(np.argmax(fitness))], history


def judged(folded: DataFrame, by: dict, p: int, candidates: dict[str, dict[str, np.ndarray]], components: int) -> dict[str, tuple[float, float]]:
    """(accuracy, balanced accuracy) of each candidate over the rows of all folds, in one pass.

    folded: fold, label, x, with a target for each class in the order of their names. A candidate has the channels
    of each fold's model; the model is fitted on the other folds' moments. All models, p + 1 numbers for each
    candidate, fold and class, go to the tasks; counts by candidate, label and predicted class come back."""
    total = _sum(by)
    kinds = len(total.total) - p
    names, folds = list(candidates), list(by)
    table = np.zeros((len(names), len(folds), p + 1, kinds))
    for i, name in enumerate(names):
        for j, f in enumerate(folds):
            keep = np.flatnonzero(candidates[name][f])
            model = fit_pls((total - by[f]).subset(np.concatenate([keep, np.arange(p, p + kinds)])), len(keep), min(components, len(keep)))
            b = model.coefficients(model.w.shape[1])
            table[i, j, 0] = model.y_mean - model.x_mean @ b
            table[i, j, keep + 1] = b
    classes = sorted(r[0] for r in folded.select("label").where("label is not null").distinct().collect())
    if len(classes) != kinds:
        raise ValueError(f"{kinds} targets and {len(classes)} labels")
    shared = folded.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros((len(names), kinds, kinds), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            fold = np.array([folds.index(f) for f in b.column(0).to_pylist()])
            label = np.array([classes.index(k) for k in b.column(1).to_pylist()])
            x = np.hstack([np.ones((b.num_rows, 1)), matrix(b.column(2))])
            for j in np.unique(fold):
                on = fold == j
                for i in range(len(names)):
                    np.add.at(hits[i], (label[on], (x[on] @ shared.value[i, j]).argmax(1)), 1)
        at = np.indices(hits.shape).reshape(3, -1)
        yield pa.record_batch([pa.array(v, pa.int32()) for v in at] + [pa.array(hits.ravel())], ["i", "k", "named", "n"])

    rows = folded.select(F.col("fold").cast("string").alias("fold"), "label", "x").where("fold is not null and label is not null and x is not null")
    counts = np.zeros((len(names), kinds, kinds))
    for r in rows.mapInArrow(count, "i int, k int, named int, n long").groupBy("i", "k", "named").agg(F.sum("n").alias("n")).collect():
        counts[r["i"], r["k"], r["named"]] = r["n"]
    out = {}
    for name, c in zip(names, counts, strict=True):
        there = c.sum(1)
        out[name] = (float(np.trace(c) / max(c.sum(), 1)), float((np.diag(c)[there > 0] / there[there > 0]).mean()) if there.any() else 0.0)
    return out


def judged_intervals(folded: DataFrame, p: int, components: int, intervals: int = 8) -> pd.DataFrame:
    """first, last, q2, balanced_accuracy, winner of each interval: the best balanced accuracy, of equal ones the
    best q2, then the first."""
    by = moments(folded, "fold")
    t = interval_table(by, p, components, intervals)
    masks = {str(i): {f: (np.arange(p) >= r.first) & (np.arange(p) <= r.last) for f in by} for i, r in enumerate(t.itertuples(index=False))}
    got = judged(folded, by, p, masks, components)
    t["balanced_accuracy"] = [got[str(i)][1] for i in range(len(t))]
    t["winner"] = t.index == t.sort_values(["balanced_accuracy", "q2", "first"], ascending=[False, False, True]).index[0]
    return t


METHODS: dict[str, Choose] = {
    "full": lambda by, p, a: np.ones(p, bool),
    "interval": interval_mask,
    "vip": vip_mask,
    "sr": sr_mask,
    "sparse": sparse_mask,
    "spa": projection_mask,
    "genetic": lambda by, p, a: genetic(by, p, a)[0],
}


def chosen_by_fold(by: dict, p: int, components: int, choose: Choose) -> dict[str, np.ndarray]:
    """The channels that each fold's others choose. Fewer than two chosen: all."""
    out = {}
    for k in by:
        keep = choose({f: v for f, v in by.items() if f != k}, p, components)
        out[k] = keep if keep.sum() >= 2 else np.ones(p, bool)
    return out


def nested(by: dict, p: int, components: int, choose: Choose, masks: dict[str, np.ndarray] | None = None) -> tuple[float, float, int, int]:
    """(q2, mean, least and most number of channels): the channels are chosen anew on the other folds for each
    fold, so a fold never judges channels that it helped to choose."""
    total = _sum(by)
    masks = chosen_by_fold(by, p, components, choose) if masks is None else masks
    press, sizes = 0.0, []
    for k, m in by.items():
        sizes.append(int(masks[k].sum()))
        columns = np.concatenate([np.flatnonzero(masks[k]), np.arange(p, len(total.total))])
        model = fit_pls((total - m).subset(columns), sizes[-1], min(components, sizes[-1]))
        press += error_sum(model, model.w.shape[1], m.subset(columns), sizes[-1]).sum()
    return float(max(-1.0, 1 - press / np.trace(total.centred()[1][p:, p:]))), float(np.mean(sizes)), min(sizes), max(sizes)


def selection_table(folded: DataFrame, p: int, components: int, methods: tuple[str, ...] = tuple(METHODS), slack: float = 0.01) -> pd.DataFrame:
    """method, n_vars, least_vars, most_vars, q2 and balanced_accuracy (nested), q2_open (of the channels chosen on
    all folds, which is biased), winner: of the methods within the slack of the best nested balanced accuracy, and
    of these within the slack of the best nested q2, the one of fewest channels. Without labels q2 alone counts.
    All methods are judged in one pass over the rows."""
    by = moments(folded, "fold")
    rows, masks = [], {}
    for name in methods:
        keep = METHODS[name](by, p, components)
        masks[name] = chosen_by_fold(by, p, components, METHODS[name])
        q2, _, least, most = nested(by, p, components, METHODS[name], masks[name])
        rows.append((name, int(keep.sum()), least, most, q2, q2_of(by, p, keep if keep.sum() >= 2 else np.ones(p, bool), components)))
    t = pd.DataFrame(rows, columns=["method", "n_vars", "least_vars", "most_vars", "q2", "q2_open"])
    near = t
    if "label" in folded.columns:
        got = judged(folded, by, p, masks, components)
        t["balanced_accuracy"] = [got[m][1] for m in t["method"]]
        near = t[t["balanced_accuracy"] >= t["balanced_accuracy"].max() - slack]
    near = near[near["q2"] >= near["q2"].max() - slack]
    t["winner"] = t.index == near.sort_values(["n_vars", "method"]).index[0]
    return t
