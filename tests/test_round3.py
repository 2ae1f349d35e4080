"""Fold-safe preprocessing, leave-one-out distances, Procrustes sets, kernel machines, attributions, ranks, hulls,
splits by kinds and edges of the core."""

import itertools
import os
import subprocess
import sys
import time
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from prismlake.functions import rowlocal as R
from prismlake.functions.ranks import signed_rank
from prismlake.operators import attribution, benchmark, diagnostics, gram, hull, kernel, latent, oneclass, pipeline, preprocess, selection, splits, validation
from prismlake.streaming import scoring

SCHEMA = "sample_id long, label string, conc double, group_id string, x array<double>"


def table(spark, x, labels, groups=None, conc=None):
    groups = groups if groups is not None else [f"g{i // 3}" for i in range(len(x))]
    conc = conc if conc is not None else [0.0] * len(x)
    return spark.createDataFrame([(i, str(k), float(c), str(g), [float(v) for v in r]) for i, (r, k, g, c) in enumerate(zip(x, labels, groups, conc, strict=True))], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    k = np.arange(90) % 3
    base = np.exp(-((np.linspace(0, 1, 60)[None] - 0.3 - 0.1 * k[:, None]) ** 2) / 0.02)
    return base * rng.uniform(0.5, 2, (90, 1)) + rng.normal(0, 0.05, (90, 60)) + rng.normal(0, 1, (90, 1)), k


# ------------------------------------------------------------------ rows


def test_steps_compose_at_700_channels(spark):
    """Each transform is computed once a row, whatever stands before it: seconds, not minutes."""
    x = np.random.default_rng(1).normal(size=(300, 700)).cumsum(1)
    df = table(spark, x, ["a"] * 300).cache()
    df.count()
    began = time.monotonic()
    chain = R.savgol(R.snv(R.msc(F.col("x"), R.constants(x.mean(0)))), 25)
    got = np.array([r[0] for r in df.orderBy("sample_id").select(R.l2_normalize(chain)).collect()])
    assert time.monotonic() - began < 20
    b = np.array([np.polyfit(x.mean(0), r, 1) for r in x])
    m = (x - b[:, 1:]) / b[:, :1]
    s = (m - m.mean(1, keepdims=True)) / m.std(1, keepdims=True)
    want = s @ R.savgol_kernel(700, 25)
    np.testing.assert_allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-9)


def test_published_savgol_weights():
    """Quadratic first derivative: i over the sum of squares in the middle, and the fitted line's slope aside of it."""
    for window in (5, 7, 25):
        h = window // 2
        i = np.arange(-h, h + 1)
        s2, s4 = (i**2).sum(), (i**4).sum()
        want = i / s2 + 2 * i[:, None] * (window * i**2 - s2) / (window * s4 - s2**2)
        np.testing.assert_allclose(R.savgol_weights(window), want, atol=1e-12)


@pytest.mark.parametrize("names", [("snv", "savgol", "center"), ("msc", "savgol", "center"), ("autoscale",), ("l2", "msc", "autoscale", "savgol", "center"), ("msc", "autoscale")])
def test_folds_learn_from_the_others_only(spark, data, names):
    """Curve and predictions equal a plain cross-validation that refits everything in each fold; one fold is
    shifted far off, which leaks at once if any state sees it."""
    x, k = data
    x = x.copy()
    x[:30] += 50
    fold = np.arange(90) // 30
    rows, classes = latent.with_targets(table(spark, x, k).withColumn("fold", F.expr("cast(sample_id div 30 as int)")))
    steps = pipeline.Steps(names, 11)

    def prepare(train, other):
        for n in names:
            if n in ("snv", "l2", "savgol"):
                f = lambda z, n=n: pipeline.Steps((n,), 11).apply(z, [])
            elif n == "msc":
                ref = train.mean(0)

                def f(z, ref=ref):
                    b = np.array([np.polyfit(ref, r, 1) for r in z])
                    return (z - b[:, 1:]) / b[:, :1]
            else:
                m, s = train.mean(0), train.std(0) if n == "autoscale" else np.ones(train.shape[1])
                f = lambda z, m=m, s=s: (z - m) / s
            train, other = f(train), f(other)
        return train, other

    y = np.eye(3)[k]
    want, press = np.zeros((90, 3)), np.zeros(4)
    for f in range(3):
        a, b = prepare(x[fold != f], x[fold == f])
        z = np.hstack([a, y[fold != f]])
        model = latent.fit_pls(gram.Moments(len(z), z.sum(0), z.T @ z), x.shape[1], 4)
        for c in range(4):
            got = model.y_mean + (b - model.x_mean) @ model.coefficients(c + 1)
            press[c] += ((y[fold == f] - got) ** 2).sum()
        want[fold == f] = got
    parts = pipeline.fold_moments(rows, steps)
    np.testing.assert_allclose([c[1] for c in pipeline.curve(parts, 3, 4)], np.sqrt(press / 270), rtol=1e-6)
    got = np.array([r["scores"] for r in pipeline.out_of_fold(rows, classes, steps, 4).orderBy("sample_id").collect()])
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_comparison_of_preprocessings(spark, data):
    x, k = data
    got = {r["preprocessing"]: r for r in validation.compare_preprocessings(table(spark, x, k), 4, 3, 11).collect()}
    assert set(got) == set(validation.VARIANTS) and got["snv"]["balanced_accuracy"] > 0.95 and all(r["note"] is None for r in got.values())
    wide = {r["preprocessing"]: r for r in validation.compare_preprocessings(table(spark, x, k), 2, 3, 61).collect()}
    assert wide["sg"]["components"] is None and "window" in wide["sg"]["note"] and wide["snv"]["components"]


# ------------------------------------------------------------------ distances


def refit_q(x, a):
    out = []
    for i in range(len(x)):
        t = np.delete(x, i, 0)
        v = np.linalg.svd(t - t.mean(0), full_matrices=False)[2][: min(a, len(t) - 1)]
        c = x[i] - t.mean(0)
        out.append(c @ c - ((v @ c) ** 2).sum())
    return np.array(out)


@pytest.mark.parametrize(("n", "p", "a"), [(40, 8, 3), (12, 60, 4), (200, 30, 5), (6, 5, 4), (4, 30, 5)])
def test_leave_one_out_q_is_the_refit(n, p, a):
    rng = np.random.default_rng(n)
    for x in (rng.normal(size=(n, p)) * np.logspace(0, -4, p) + 3, np.repeat(rng.normal(size=(-(-n // 3), p)), 3, 0)[:n], np.eye(p)[rng.integers(0, p, n)] * np.arange(1, p + 1)):
        z = np.hstack([x, np.zeros((n, 1))])
        m = gram.Moments(n, z.sum(0), z.T @ z)
        if np.linalg.matrix_rank(x - x.mean(0), tol=1e-9) <= min(a, n - 2) + 1:
            continue  # the plane is not unique
        np.testing.assert_allclose(diagnostics.loo_residuals(diagnostics.Spectrum.of(m, p), x, a), refit_q(x, a), atol=1e-9)


def test_leave_one_out_q_of_many_wide_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 20)) @ rng.normal(size=(20, 700)) + 0.01 * rng.normal(size=(2000, 700))
    z = np.hstack([x, np.zeros((2000, 1))])
    began = time.monotonic()
    got = diagnostics.loo_residuals(diagnostics.Spectrum.of(gram.Moments(2000, z.sum(0), z.T @ z), 700), x, 5)
    assert time.monotonic() - began < 30 and (got > 0).all()
    np.testing.assert_allclose(got[:2], [refit_one(x, i, 5) for i in range(2)], rtol=1e-9)


def refit_one(x, i, a):
    t = np.delete(x, i, 0)
    v = np.linalg.svd(t - t.mean(0), full_matrices=False)[2][:a]
    c = x[i] - t.mean(0)
    return c @ c - ((v @ c) ** 2).sum()


def test_procrustes_set(spark, data):
    """Against a plain version; scores keep their lengths, residuals too."""
    x, k = data
    x, k = x[:60], (k[:60] > 0).astype(int)
    groups = [f"{k[i]}-{i // 6}" if k[i] else "only" for i in range(60)]
    got = {}
    for r in oneclass.procrustes_set(table(spark, x, k, groups), 3).collect():
        got.setdefault(r["label"], []).append(r["x"])
    for label in (0, 1):
        own = x[k == label]
        names = np.array(groups)[k == label] if label else np.arange(len(own)).astype(str)
        v = np.linalg.svd(own - own.mean(0), full_matrices=False)[2][:3].T
        want = []
        for g in np.unique(names):
            t, mine = own[names != g], own[names == g]
            w = np.linalg.svd(t - t.mean(0), full_matrices=False)[2][:3].T
            c = mine - t.mean(0)
            u, _, h = np.linalg.svd(w.T @ v)
            q = (c**2).sum(1) - ((c @ w) ** 2).sum(1)
            e = (mine - own.mean(0)) @ (np.eye(60) - v @ v.T)
            want.append(own.mean(0) + c @ w @ u @ h @ v.T + e * np.sqrt(q / (e**2).sum(1))[:, None])
        want = np.concatenate(want)
        order = lambda m: m[np.argsort(m[:, 0])]
        np.testing.assert_allclose(order(np.array(got[str(label)])), order(want), atol=1e-7)
    s = {r["label"]: r for r in oneclass.procrustes_sensitivity(table(spark, x, k, groups), 3).collect()}
    assert s["0"]["note"].startswith("one group") and s["1"]["note"] == "exploratory" and 0.5 <= s["1"]["sensitivity"] <= 1
    few = oneclass.procrustes_sensitivity(table(spark, x[:2], [0, 0])).collect()
    assert few[0]["sensitivity"] is None and few[0]["note"] == "not validated"


def test_new_samples_by_combined_distance(spark):
    """About alpha of new rows of the training distribution are refused, not twice as many."""
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(6, 60))
    draw = lambda n: rng.normal(size=(n, 6)) @ mix + 0.3 * rng.normal(size=(n, 60))
    package = scoring.train_package(table(spark, draw(150), np.arange(150) % 2), 4)
    new = scoring.score(table(spark, np.vstack([draw(400), draw(5) + 20]), ["?"] * 405), package)
    r = new.agg(F.avg(F.when(F.col("sample_id") < 400, (~F.col("accepted")).cast("double"))).alias("refused"), F.count_if((F.col("sample_id") >= 400) & F.col("accepted")).alias("far")).first()
    assert 0.01 < r["refused"] < 0.1 and r["far"] == 0
    with pytest.raises(ValueError, match="distance_limit"):
        scoring.score(table(spark, draw(1), ["?"]), {k: v for k, v in package.items() if k != "distance_limit"})


def test_hull(spark):
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(300, 2)), 2)
    rows = [("a", *map(float, p)) for p in points] + [("b", 0.0, 0.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 1.0), ("c", 1.0, 1.0), ("d", None, 1.0), ("e", float("nan"), 0.0), (None, 0.0, 0.0)]
    got = hull.convex_hull(spark.createDataFrame(rows, "k string, u double, v double").repartition(7), "k", "u", "v").orderBy("k", "step").collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["x"], r["y"]))
    assert by["b"] == [(0, 0), (2, 2)] and by["c"] == [(1, 1)] and set(by) == {"a", "b", "c"}
    inside = lambda p, t: all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-12 for a, b in zip(t, t[1:] + t[:1], strict=True))
    assert all(inside(p, by["a"]) for p in points.tolist())
    for v in by["a"]:  # no vertex is inside of the hull of the others
        assert not inside(v, [w for w in by["a"] if w != v])


# ------------------------------------------------------------------ learners


def test_fourier_features(spark):
    x = np.random.default_rng(0).normal(size=(80, 30))
    f = kernel.Fourier.of(x.mean(0), 0.02, 4096)
    z = f.apply(x)
    true = np.exp(-0.02 * ((x[:, None] - x[None]) ** 2).sum(2))
    error = z @ z.T - true
    assert np.sqrt((error**2).mean()) <= 1 / np.sqrt(4096) and np.abs(error).max() < 6 / np.sqrt(4096)
    df = table(spark, x, ["a"] * 80).unionByName(spark.createDataFrame([(999, "a", 0.0, "g", None)], SCHEMA))
    got = {r["sample_id"]: r["features"] for r in f.transform(df).collect()}
    assert got[999] is None
    np.testing.assert_allclose([got[i] for i in range(80)], z)


def test_newton_reaches_the_minimum(spark, data):
    """Gradients vanish at the weights, for both losses and for every fold."""
    x, k = data
    y = np.hstack([2 * np.eye(3)[k] - 1])
    fold = np.arange(90) % 3
    rows = spark.createDataFrame([(int(f), r.tolist(), t.tolist()) for f, r, t in zip(fold, x, y, strict=True)], "fold int, x array<double>, y array<double>").repartition(3)
    f = kernel.Fourier.of(x.mean(0), 0.05, 64)
    z = np.hstack([np.ones((90, 1)), f.apply(x)])
    for epsilon in (None, 0.1):
        for (left, j), w in kernel.newton(rows, f, [0, 1, 2, None], 3, epsilon).items():
            on = np.ones(90, bool) if left is None else fold != left
            r = y[on, j] - z[on] @ w
            loss = np.where(y[on, j] * (z[on] @ w) < 1, r, 0) if epsilon is None else np.sign(r) * np.maximum(np.abs(r) - epsilon, 0)
            gradient = -2 * z[on].T @ loss + np.concatenate([[0], w[1:]])
            assert np.abs(gradient).max() < 1e-4


def test_benchmarks(spark, data):
    x, k = data
    got = {r["model"]: r for r in benchmark.classifiers(table(spark, x, k), 4, 3, {"forest": lambda: RandomForestClassifier(numTrees=5, seed=1), "broken": lambda: RandomForestClassifier(maxDepth=-3)}, pipeline.Steps(("snv", "center"))).collect()}
    assert list(got) == ["pls_da", "svm_rbf", "forest", "broken"]
    assert got["pls_da"]["balanced_accuracy"] > 0.95 and got["pls_da"]["p_value"] is None and got["broken"]["note"] and got["broken"]["f1"] is None
    assert got["forest"]["balanced_accuracy_sd"] >= 0 and (got["forest"]["p_value"] or 1) >= 0.25  # three folds can't say more
    scored = {n: d for n, d, _ in benchmark.out_of_fold(table(spark, x, k), 3, 3, {})}
    p = scored["svm_rbf"].agg(F.count("*").alias("n"), F.min(F.aggregate("probability", F.lit(0.0), lambda a, v: a + v)).alias("s")).first()
    assert p["n"] == 90 and p["s"] == pytest.approx(1)


def test_regressors_by_class(spark, data):
    x, k = data
    conc = np.arange(90) % 7 * 2.0
    x = x + conc[:, None] * np.sin(np.linspace(0, 3, 60)) * 0.2
    parted = table(spark, x, k, conc=conc).withColumn("part", F.when(F.col("sample_id") % 4 == 0, "validation").otherwise("calibration"))
    got = {r["model"]: r for r in benchmark.regressors(parted, 6, {}).collect()}
    assert set(got) == {"pls", "svr_rbf"} and got["pls"]["r2"] > 0.9
    each = benchmark.regressors(parted, 4, {}, by_class=True).collect()
    assert {(r["label"], r["model"]) for r in each} == {(str(i), m) for i in range(3) for m in ("pls", "svr_rbf")}


def test_selection_is_judged_by_balanced_accuracy(spark, data):
    """Against a loop that refits every fold of every candidate and scores its rows."""
    x, k = data
    folded, classes = latent.with_targets(splits.hashed_folds(table(spark, x, k), 3))
    fold = {r["sample_id"]: r["fold"] for r in folded.select("sample_id", "fold").collect()}
    f = np.array([fold[i] for i in range(90)])
    by = gram.moments(folded, "fold")
    masks = {"low": {str(j): np.arange(60) < 20 + j for j in range(3)}, "all": {str(j): np.ones(60, bool) for j in range(3)}}
    got = selection.judged(folded, by, 60, masks, 4)
    for name in masks:
        hit = np.zeros(90, bool)
        for j in range(3):
            keep = masks[name][str(j)]
            z = np.hstack([x[f != j][:, keep], np.eye(3)[k[f != j]]])
            m = latent.fit_pls(gram.Moments(len(z), z.sum(0), z.T @ z), int(keep.sum()), 4)
            hit[f == j] = (m.y_mean + (x[f == j][:, keep] - m.x_mean) @ m.coefficients(4)).argmax(1) == k[f == j]
        assert got[name] == pytest.approx((hit.mean(), np.mean([hit[k == c].mean() for c in range(3)])))
    t = selection.selection_table(folded, 60, 3, ("full", "vip", "interval"))
    best = t.loc[t["winner"]].iloc[0]
    assert t["winner"].sum() == 1 and best["balanced_accuracy"] >= t["balanced_accuracy"].max() - 0.01
    i = selection.judged_intervals(folded, 60, 3)
    assert i["winner"].sum() == 1 and i.loc[i["winner"], "balanced_accuracy"].iloc[0] == i["balanced_accuracy"].max()


def test_signed_ranks():
    """Tabulated: n = 5 all of one sign, p = 2/32; n = 8 with W = 3, p = 10/256; with ties, by listing all signs."""
    assert signed_rank([2, 3, 4, 5, 6], [1, 1, 1, 1, 1]) == (0, 2 / 32)
    assert signed_rank([1, 2, -3, 4, 5, 6, 7, 8], [0] * 8) == (3, 10 / 256)
    assert signed_rank([1, 2], [1, 2]) is None and signed_rank([], []) is None
    d = np.array([0.5, -0.5, 0.5, 1.0, 1.0, -2.0, 0.0, 3.0])
    d0 = d[d != 0]
    order = np.argsort(np.argsort(np.abs(d0), kind="stable"))
    ranks = np.array([np.mean([r + 1 for r, v in zip(order, np.abs(d0), strict=True) if v == w]) for w in np.abs(d0)])
    low = min(ranks[d0 > 0].sum(), ranks[d0 < 0].sum())
    ways = sum(ranks[np.array(s, bool)].sum() <= low for s in itertools.product([0, 1], repeat=len(d0)))
    assert signed_rank(d, np.zeros(8)) == (low, min(1.0, 2 * ways / 2 ** len(d0)))
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    exact, wide = signed_rank(a, np.zeros(200))[1], signed_rank(np.concatenate([a, [1e-9]]), np.zeros(201))[1]
    assert exact == pytest.approx(wide, abs=0.01)


def brute_shapley(leaves, x):
    """Over all subsets of channels, from the path-dependent expectation."""
    p, outputs = len(x), len(leaves[0].value)

    def value(known):
        total = np.zeros(outputs)
        for leaf in leaves:
            w = 1.0
            for f, lo, hi, z in zip(leaf.features, leaf.low, leaf.high, leaf.share, strict=True):
                w *= (lo < x[f] <= hi) if f in known else z
            total += w * leaf.value
        return total

    phi = np.zeros((p, outputs))
    for i in range(p):
        rest = [j for j in range(p) if j != i]
        for n in range(p):
            for s in itertools.combinations(rest, n):
                phi[i] += factorial(n) * factorial(p - n - 1) / factorial(p) * (value({*s, i}) - value(set(s)))
    return phi


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_tree_attributions(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int)
    df = table(spark, x, y, conc=x[:, 0] * 2 + x[:, 3]).withColumn("features", array_to_vector("x")).withColumn("target", F.col("label").cast("double"))
    if kind == "forest":
        model = RandomForestClassifier(numTrees=4, maxDepth=4, seed=2, labelCol="target").fit(df)
        predicted = {(r["sample_id"], i): float(r["probability"][i]) for r in model.transform(df).collect() for i in range(2)}
    else:
        model = GBTRegressor(maxIter=4, maxDepth=3, seed=2, labelCol="conc").fit(df)
        predicted = {(r["sample_id"], 0): r["prediction"] for r in model.transform(df).collect()}
    rows = attribution.tree_attributions(df, model).collect()
    assert len(rows) == len(predicted)
    for r in rows:
        assert r["base"] + sum(r["shap"]) == pytest.approx(predicted[r["sample_id"], r["output"]], abs=1e-9)
    leaves = attribution.flatten(model)
    _, phi = attribution.shapley(leaves, x[:3])
    for i in range(3):
        np.testing.assert_allclose(phi[i], brute_shapley(leaves, x[i]), atol=1e-10)
    top = attribution.importance(attribution.tree_attributions(df, model)).orderBy(F.desc("importance")).first()
    assert top["j"] in (0, 1, 2, 3)


# ------------------------------------------------------------------ splits


def test_grouped_folds_by_kinds(spark):
    """Every group whole in one fold, classes as even as counts allow, and the same from any partitioning."""
    rows = [(i, f"c{g % 4}" if g % 9 else f"c{i % 4}", 0.0, f"g{g}", [0.0]) for i, g in enumerate(g for g in range(400) for _ in range(1 + g % 3))]
    df = spark.createDataFrame(rows, SCHEMA)
    folds = {r["group_id"]: r["fold"] for r in splits.grouped_folds(df, 5).collect()}
    assert folds == {r["group_id"]: r["fold"] for r in splits.grouped_folds(df.repartition(9), 5).collect()} and len(folds) == 400
    n = np.zeros((5, 4))
    for _, label, _, g, _ in rows:
        n[folds[g], int(label[1])] += 1
    assert (n.max(0) - n.min(0)).max() <= 6
    assert {r["group_id"]: r["fold"] for r in splits.grouped_folds(df, 5, seed=7).collect()} != folds
    with pytest.raises(ValueError, match="folds need"):
        splits.grouped_folds(df.where("group_id = 'g1'"), 5)


@pytest.mark.parametrize("candidates", [3, 64])
def test_kennard_stone_is_farthest_first(spark, monkeypatch, candidates):
    monkeypatch.setattr(splits, "CANDIDATES", candidates)
    x = np.round(np.random.default_rng(8).normal(size=(60, 4)), 1)
    x[50:] = x[40:50]  # ties
    df = spark.createDataFrame([(f"g{i:02d}", r.tolist()) for i, r in enumerate(x)], "group_id string, x array<double>").repartition(5)
    d = np.round(((x - x.mean(0)) ** 2).sum(1), 12)
    want = [min(range(60), key=lambda i: (-d[i], i))]
    while len(want) < 30:
        d = np.round(((x[:, None] - x[want][None]) ** 2).sum(2).min(1), 12)
        want.append(min((i for i in range(60) if i not in want), key=lambda i: (-d[i], i)))
    assert splits.kennard_stone(df, 30) == [f"g{i:02d}" for i in want]
    assert len(splits.kennard_stone(df, 100)) == 60 and splits.kennard_stone(df.limit(0), 3) == [] and splits.kennard_stone(df, 0) == []


def test_kennard_stone_split_leaves_one_pass_on_disk(spark, monkeypatch):
    """As many passes as there may be: no more than two have files at a time, and the parts are those of the list."""
    from prismlake.functions import tables
    from prismlake.operators import validation

    monkeypatch.setattr(splits, "CANDIDATES", 5)
    x = 100 + np.random.default_rng(9).normal(size=(60, 4))
    x[50:] = x[40:50]  # ties
    df = spark.createDataFrame([(f"g{i:02d}", r.tolist()) for i, r in enumerate(x)], "group_id string, x array<double>").repartition(5)
    files, most = set(), [0]

    def written(frame):
        out = tables.written(frame)
        files.add(out.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:"))
        most[0] = max(most[0], sum(os.path.isdir(f) for f in files))
        return out

    monkeypatch.setattr(splits, "written", written)
    monkeypatch.setattr(splits, "stored", lambda frame: pytest.fail("a checkpoint for each pass"))
    chosen = splits.kennard_stone(df, 48)
    assert len(files) > 5 and most[0] <= 2
    got = {r["group_id"]: r["part"] for r in validation.kennard_stone_split(df).collect()}
    assert sorted(g for g, p in got.items() if p == "calibration") == sorted(chosen) and len(got) == 60


# ------------------------------------------------------------------ edges


def test_edges(spark, data):
    x, k = data
    df = table(spark, x, k)
    with_null = df.unionByName(spark.createDataFrame([(1000, "0", 0.0, "n", None)], SCHEMA))
    a, b = (gram.moments(d.withColumn("y", F.array(F.lit(0.0))), "label") for d in (df, with_null))
    assert all(np.allclose(a[c].cross, b[c].cross) for c in a)
    ragged = df.unionByName(spark.createDataFrame([(1000, "0", 0.0, "n", [1.0])], SCHEMA))
    with pytest.raises(Exception, match="different lengths"):
        gram.moments(ragged.withColumn("y", F.array(F.lit(0.0))), "label")
    assert gram.moments(df.limit(0).withColumn("y", F.array(F.lit(0.0))), "label") == {}
    for f in (lambda d: oneclass.fit(d), lambda d: validation.monte_carlo(d, 2), lambda d: scoring.train_package(d, 2), lambda d: diagnostics.applicability(d, 2)):
        with pytest.raises(ValueError, match="no row with a spectrum"):
            f(df.limit(0))
    assert df.limit(0).select(R.savgol(R.snv(F.col("x")), 25)).count() == 0
    assert with_null.where("x is null").select(R.savgol(R.snv(F.col("x")), 25).alias("v")).first()["v"] is None
    assert preprocess.fit_apply(df, with_null, ("msc", "savgol", "center"), 25).where("x is null").count() == 1


def test_csv_headers_must_agree(spark, tmp_path):
    """Files of one folder with other column orders don't mix silently."""
    from prismlake.sources import readers

    (tmp_path / "a.csv").write_text("kind;100;101\nA;1;2\n")
    (tmp_path / "b.csv").write_text("kind;101;100\nB;1;2\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        readers.read_csv(spark, str(tmp_path), label="kind").collect()


def test_registry_in_a_fresh_interpreter():
    code = "from prismlake.sources import readers as r\nassert r.kinds() == ['csv', 'images', 'spectra', 'synthetic', 'tecator'], r.kinds()\nassert r.reader('images').__name__ == 'read_images'\ntry:\n    r.reader('x')\nexcept ValueError as e:\n    assert 'csv, images, spectra, synthetic' in str(e)\n"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
