"""Selection, validation, one-class, diagnostics and calibration against numpy versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions import quantiles
from prismlake.functions import rowlocal as R
from prismlake.functions.ordering import by_hash, by_number, numbered
from prismlake.operators import benchmark, diagnostics, latent, oneclass, preprocess, quantify, selection, splits, validation
from prismlake.operators.gram import moments
from prismlake.sources import readers


@pytest.fixture(scope="module")
def spectra(spark):
    return readers.read(spark, "synthetic", channels=20).cache()


@pytest.fixture(scope="module")
def frame(spectra):
    f = spectra.orderBy("sample_id").toPandas()
    return np.stack(f["x"]), f


def test_numbers_without_one_task(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), (F.col("id") % 3).alias("k"))
    got = numbered(rows, by_number(F.col("v"), 0, 999, 16), "v").toPandas()
    assert (got["rank"] == got["v"] + 1).all()
    h = F.md5(F.col("v").cast("string"))
    got = numbered(rows.withColumn("h", h), by_hash(F.col("h")), "h", keys=("k",)).toPandas()
    for _, g in got.groupby("k"):
        assert list(g.sort_values("h")["rank"]) == list(range(1, len(g) + 1))


def test_opls(spectra, frame):
    x, f = frame
    y = f["conc"].to_numpy() - f["conc"].mean()
    xr, ts = x - x.mean(0), []
    for _ in range(2):
        w = xr.T @ y / np.linalg.norm(xr.T @ y)
        t = xr @ w
        p = xr.T @ t / (t @ t)
        o = p - (p @ w) * w
        o /= np.linalg.norm(o)
        u = xr @ o
        u = u - (u @ t) / (t @ t) * t
        xr = xr - np.outer(u, xr.T @ u / (u @ u))
        ts.append(u)
    w = xr.T @ y / np.linalg.norm(xr.T @ y)
    model = diagnostics.fit_opls(diagnostics.whole(spectra, F.array("conc")), x.shape[1], 2)
    got = spectra.orderBy("sample_id").select(model.predictive(F.col("x")).alias("t"), model.scores(F.col("x")).alias("o")).toPandas()
    t = got["t"].to_numpy()
    np.testing.assert_allclose(np.abs(t), np.abs(xr @ w), atol=1e-7)
    o = np.stack(got["o"])
    for k in range(2):
        np.testing.assert_allclose(np.abs(o[:, k]), np.abs(ts[k]), atol=1e-7)
        assert abs(o[:, k] @ t) < 1e-6


def _pca(x, a):
    mean = x.mean(0)
    _, s, v = np.linalg.svd(x - mean, full_matrices=False)
    return mean, v[:a].T, s[:a] ** 2 / (len(x) - 1)


def test_leave_one_out_q(spectra, frame):
    x, f = frame
    m = diagnostics.whole(spectra)
    got = diagnostics.loo_q(spectra.select("sample_id", "x").withColumn("all", F.lit("all")), "all", {"all": m}, 3).orderBy("sample_id").toPandas()["q_loo"].to_numpy()
    for i in range(0, len(x), 17):
        mean, p, _ = _pca(np.delete(x, i, 0), 3)
        c = x[i] - mean
        assert got[i] == pytest.approx(c @ c - ((c @ p) ** 2).sum(), rel=1e-6)
    domain = diagnostics.applicability(spectra, 3)
    assert domain.q0 == pytest.approx(got.mean()) and domain.nq == pytest.approx(2 * (got.mean() / got.std(ddof=1)) ** 2)
    inside = domain.score(spectra).agg(F.avg(F.col("inside").cast("int"))).first()[0]
    far = domain.score(spectra.withColumn("x", F.transform("x", lambda v: v * 3 + 1)))
    assert inside > 0.85 and far.where("inside").count() == 0


def test_leave_group_out(spark, spectra, frame):
    x, f = frame
    got = {r["label"]: r for r in oneclass.leave_group_out(spectra, 2).collect()}
    for label in ("C0", "C1"):
        own = (f["label"] == label).to_numpy()
        right = []
        for g in sorted(set(f["group_id"][own])):
            out = own & (f["group_id"] == g).to_numpy()
            rest = own & ~out
            mean, p, var = _pca(x[rest], 2)
            t = (x - mean) @ p
            t2, q = (t**2 / var).sum(1), ((x - mean) ** 2).sum(1) - (t**2).sum(1)
            by = f[rest].assign(t2=t2[rest], q=q[rest]).groupby("group_id")[["t2", "q"]].mean()
            (h0, q0), (hs, qs) = by.mean(), by.std()
            nh, nq = 2 * (h0 / hs) ** 2, 2 * (q0 / qs) ** 2
            right.append(t2[out].mean() / h0 * nh + q[out].mean() / q0 * nq <= quantiles.chi2(spark, 0.95, nh + nq))
        assert got[label]["sensitivity"] == pytest.approx(np.mean(right)) and got[label]["n_groups"] == len(right)
    few = oneclass.leave_group_out(spectra.where("group_id in ('C0-00')"), 2).first()
    assert few["sensitivity"] is None and few["note"] == "not validated"


def test_leave_group_out_in_blocks(spectra, monkeypatch):
    """Refits don't come to the driver, and blocks of rows and of refits give what one block gives."""
    monkeypatch.setattr(type(spectra), "toPandas", lambda self: pytest.fail("refits on the driver"))
    whole = sorted(map(tuple, oneclass.leave_group_out(spectra, 2).collect()))
    monkeypatch.setattr(oneclass, "ROW_BLOCK", 7)
    monkeypatch.setattr(oneclass, "REFIT_BLOCK", 4)
    monkeypatch.setattr(oneclass, "AT_ONCE", 20)
    assert sorted(map(tuple, oneclass.leave_group_out(spectra, 2).collect())) == whole


def test_chi2_by_row(spark):
    df = [1.0, 2.7, 8.0, 40.0, 900.0]
    share = [1e-3, 0.2, 0.5, 0.95, 0.999]
    rows = [(quantiles.chi2(spark, p, k), k, p) for k in df for p in share] + [(0.0, 3.0, 0.0)]
    got = spark.createDataFrame(rows, "v double, k double, p double").select("p", quantiles.chi2_below(F.col("v"), F.col("k")).alias("s")).toPandas()
    np.testing.assert_allclose(got["s"], got["p"], rtol=1e-5, atol=1e-8)


def test_permutations_keep_counts_of_classes(spectra):
    classes = ["C0", "C1", "C2"]
    got = validation.permuted_labels(spectra, classes, 6).toPandas()
    labels = np.stack(got["labels"])
    own = np.array([classes.index(g.split("-")[0]) for g in got["group_id"]])
    assert (labels[:, 0] == own).all() and labels.shape == (30, 7)
    assert all((np.bincount(labels[:, r]) == np.bincount(own)).all() for r in range(7))
    assert not (labels[:, 1] == labels[:, 2]).all()
    points = validation.wold_test(spectra, classes, 2, 4, 10)
    line = validation.wold_lines(points).first()
    p = points.toPandas()
    assert p["similarity"][0] == 1 and p["q2"][0] > 0.5 and line["slope_q2"] == pytest.approx(np.polyfit(p["similarity"], p["q2"], 1)[0])


def test_rounds_are_not_ordered_whole(spectra, monkeypatch):
    """Labels and test groups of the rounds are those of the whole order, and only bounds are looked for in it."""
    monkeypatch.setattr(validation, "numbered", lambda *a, **k: pytest.fail("all rounds numbered"))
    f = spectra.select("group_id", "label").distinct().toPandas()
    classes = ["B", "C0", "C1", "C2", "D"]  # B and D have no groups
    digest = lambda r, g: (hashlib.md5(f"42:{r}:{g}".encode()).hexdigest(), g)
    got = {r["group_id"]: r["labels"] for r in validation.permuted_labels(spectra, classes, 3).collect()}
    own = {g: classes.index(k) for g, k in zip(f["group_id"], f["label"], strict=True)}
    assert {g: v[0] for g, v in got.items()} == own
    for r in (1, 2, 3):
        order = sorted(own, key=lambda g: digest(r, g))
        assert [got[g][r] for g in order] == sorted(own.values())
    tests = {(r["round"], r["group_id"]) for r in validation.shuffle_splits(spectra, 4).collect()}
    want = {(r, g) for r in range(4) for k in ("C0", "C1", "C2") for g in sorted(f["group_id"][f["label"] == k], key=lambda g: digest(r, g))[:2]}
    assert tests == want


def test_permutation_statistics_are_those_of_the_rows(spectra, frame):
    """Round 0 of the sums equals what the rows give by the ordinary way."""
    classes = ["C0", "C1", "C2"]
    p = validation.Permutations(spectra, classes, 4, 2, 42)
    rows, _ = latent.with_targets(splits.hashed_folds(spectra, 4))
    curve = latent.lv_curve(rows, 20, 2)
    assert p.q2_and_r2(0, 2)[0] == pytest.approx(curve[1][2])
    scored = latent.out_of_fold(rows, classes, 20, 2)
    hit = scored.groupBy("label").agg(F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("r")).agg(F.avg("r")).first()[0]
    assert p.balanced_accuracy(2)[0] == pytest.approx(hit)


def test_bca(spark):
    rng = np.random.default_rng(0)
    rows = [(str(k), str(k if rng.random() < 0.8 else (k + 1) % 3)) for k in rng.integers(0, 3, 300)]
    pairs = spark.createDataFrame(rows, "label string, predicted string")
    r = validation.bca_interval(pairs, rounds=400).first()
    assert r["low"] < r["observed"] < r["high"] and r["high"] - r["low"] < 0.12
    perfect = validation.bca_interval(pairs.withColumn("predicted", F.col("label")), rounds=50).first()
    assert perfect["low"] == perfect["high"] == 1.0


def test_nested_selection_does_not_see_its_fold(spark):
    """On noise, channels chosen on all folds look good on them; chosen anew for each fold they don't."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 150)), rng.normal(size=60)
    rows = spark.createDataFrame([(i, f"g{i // 2}", x[i].tolist(), [float(y[i])]) for i in range(60)], "sample_id long, group_id string, x array<double>, y array<double>")
    by = moments(splits.hashed_folds(rows, 5), "fold")
    opened = selection.q2_of(by, 150, selection.vip_mask(by, 150, 1, 1.5), 1)
    nested, mean, least, most = selection.nested(by, 150, 1, lambda b, p, a: selection.vip_mask(b, p, a, 1.5))
    assert opened > nested + 0.2 and nested < 0.1 and 2 <= least <= mean <= most


def test_sparse_mask(spectra, frame):
    x, f = frame
    rows, classes = latent.with_targets(spectra)
    by = moments(splits.hashed_folds(rows, 3), "fold")
    y = (f["label"].to_numpy()[:, None] == np.array(classes)).astype(float)
    xr, yr, chosen = x - x.mean(0), y - y.mean(0), set()
    for _ in range(2):
        w = np.linalg.svd(xr.T @ yr, full_matrices=False)[0][:, 0]
        cut = np.sort(np.abs(w))[::-1][4]
        w = np.sign(w) * np.maximum(np.abs(w) - cut, 0)
        w /= np.linalg.norm(w)
        t = xr @ w
        xr, yr = xr - np.outer(t, xr.T @ t / (t @ t)), yr - np.outer(t, yr.T @ t / (t @ t))
        chosen |= set(np.flatnonzero(w))
    assert set(np.flatnonzero(selection.sparse_mask(by, 20, 2, 4))) == chosen
    table = selection.selection_table(splits.hashed_folds(rows, 3), 20, 2, ("full", "vip", "sr", "sparse", "spa"))
    assert table["winner"].sum() == 1 and table.loc[table["winner"], "q2"].iloc[0] >= table["q2"].max() - 0.01


def test_calibration_parts(spectra):
    parted = spectra.withColumn("part", F.when(F.col("group_id").endswith("3") | F.col("group_id").endswith("7"), "validation").otherwise("calibration"))
    unknown = parted.unionByName(parted.limit(5).withColumn("conc", F.lit(None).cast("double")))
    summary, rows = quantify.calibrate_by_part(unknown, ("label",), 4)
    got = {r["label"]: r for r in summary.collect()}
    assert set(got) == {"C0", "C1", "C2"} and all(r["n_cal"] == 24 and r["n_val"] == 6 and r["r2"] > 0.9 for r in got.values())
    assert rows.count() == 18
    seen = quantify.class_seen(spectra.select("sample_id", F.lit("C9").alias("predicted")), spectra)
    assert {tuple(r) for r in seen.select("seen", "mode").distinct().collect()} == {("C9", "blind")}
    assert quantify.class_seen(None, spectra).select("mode").distinct().first()[0] == "forced-control"
    with pytest.raises(ValueError):
        quantify.class_seen(None, spectra, "other")


def test_r2_by_class_and_adulterant(spectra):
    keyed = spectra.withColumn("group_id", F.concat("group_id", F.when(F.col("conc") > 0, F.concat(F.lit("-A"), F.format_string("%.2f", "conc"))).otherwise("-P")))
    got = quantify.r2_by_class_and_adulterant(keyed).collect()
    assert len(got) == 3 and all(r["adulterant"] == "A" and r["status"] == "ok" and r["r2"] > 0.9 for r in got)


def test_bootstrap_weights_without_a_row_a_draw(spectra, monkeypatch):
    """The weights are those of the draws, in blocks, and no row is made for a draw."""
    monkeypatch.setattr(validation, "WEIGHT_BLOCK", 3, raising=False)
    monkeypatch.setattr(validation.F, "explode", lambda *a: pytest.fail("a row for each draw"))
    got = {r["group_id"]: r["weights"] for r in validation.bootstrap_weights(spectra, 5).collect()}
    f = spectra.select("group_id", "label").distinct().toPandas()
    want: dict = {}
    for k, own in f.groupby("label")["group_id"]:
        order = sorted(own, key=lambda g: (hashlib.md5(f"7:{g}".encode()).hexdigest(), g))
        for r in range(5):
            for i in range(1, len(order) + 1):
                g = order[int(hashlib.md5(f"7:{r}:{k}:{i}".encode()).hexdigest()[:15], 16) % len(order)]
                want.setdefault(g, [0] * 5)[r] += 1
    assert got == want


def test_bootstrap_and_monte_carlo(spectra):
    v = validation.bootstrap_vip(spectra, 2, 8).toPandas()
    assert len(v) == 20 and (v["low"] <= v["mean"]).all() and (v["mean"] <= v["high"]).all() and (v["sd"] > 1e-6).all() and v["frequency"].between(0, 1).all()
    m = validation.monte_carlo(spectra, 3, 6).toPandas()
    assert len(m) == 6 and (m["balanced_accuracy"] > 0.95).all() and (m["n_test"] == 18).all()
    assert validation.effective_splits(spectra, 50) == 10
    few = validation.effective_splits(spectra.where("group_id like '%-00'"), 5)
    assert few == 2


def test_benchmarks(spectra):
    c = {r["model"]: r for r in benchmark.classifiers(spectra, 3, 2, {"logistic": benchmark.CLASSIFIERS["logistic"], "broken": lambda: None}).collect()}
    assert c["pls_da"]["balanced_accuracy"] > 0.95 and c["logistic"]["balanced_accuracy"] > 0.95 and c["broken"]["note"]
    parted = spectra.withColumn("part", F.when(F.col("group_id").endswith("3"), "validation").otherwise("calibration"))
    r = {r["model"]: r for r in benchmark.regressors(parted, 4, {"ridge": benchmark.REGRESSORS["ridge"]}).collect()}
    assert r["pls"]["n"] == r["ridge"]["n"] == 9


def test_wide_spectra(spark):
    """Plans don't grow with the channels: 2,000 of them through filter, interpolation and moments."""
    p = 2000
    rng = np.random.default_rng(2)
    x = rng.normal(size=(24, p)).cumsum(1)
    e = spark.createDataFrame([(i, f"C{i % 2}", float(i), f"g{i // 2}", v.tolist()) for i, v in enumerate(x)], "sample_id long, label string, conc double, group_id string, x array<double>")
    d = R.savgol_kernel(p, 25)
    got = np.array([r[0] for r in e.orderBy("sample_id").select(R.banded(F.col("x"), d)).collect()])
    np.testing.assert_allclose(got, x @ d, atol=1e-8)
    wn = np.linspace(4000, 10000, p)
    grid = np.linspace(4100, 9900, 700)
    got = np.array([r["x"] for r in preprocess.interpolate(e, wn, grid).orderBy("sample_id").collect()])
    np.testing.assert_allclose(got, np.stack([np.interp(grid, wn, v) for v in x]), atol=1e-8)
    m = diagnostics.whole(e, F.array("conc"))
    z = np.hstack([x, np.arange(24.0)[:, None]])
    np.testing.assert_allclose(m.cross, z.T @ z, rtol=1e-9, atol=1e-6)


def test_axis_diagnosis(spark):
    rng = np.random.default_rng(3)
    wn = 4000.0 + 10 * np.arange(120)
    band = np.exp(-(((np.arange(120) - 30) / 12.0) ** 2))
    x = np.outer(rng.uniform(1, 3, 40), band) + 0.002 * rng.normal(size=(40, 120))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, x array<double>")
    regions, summary = preprocess.diagnose_axis(e, wn)
    r = regions.collect()
    assert r and all(v["kind"] == "dead" and v["first"] > 4500 for v in r)
    s = summary.first()
    assert 0.3 < s["useful"] < 0.95 and 4000.0 <= s["suggested_from"] <= 4100.0 and s["suggested_to"] < 4800.0
