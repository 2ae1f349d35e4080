"""Models against independent numpy versions, and the contracts of splits and sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions import quantiles
from prismlake.functions import rowlocal as R
from prismlake.operators import latent, metrics, oneclass, quality, quantify, resampling, splits, validation
from prismlake.operators.gram import moments
from prismlake.sources import readers
from prismlake.streaming import scoring


@pytest.fixture(scope="module")
def spectra(spark):
    return readers.read(spark, "synthetic").cache()


def _matrix(spectra):
    f = spectra.orderBy("sample_id").toPandas()
    return np.stack(f["x"]), f


def test_moments(spark, spectra):
    x, f = _matrix(spectra)
    got = moments(spectra.withColumn("y", F.array("conc")), "label")
    for k, m in got.items():
        z = np.hstack([x, f[["conc"]].to_numpy()])[(f["label"] == k).to_numpy()]
        assert m.n == len(z)
        np.testing.assert_allclose(m.cross, z.T @ z, rtol=1e-9, atol=1e-9)


def _nipals(x, y, a):
    x, y = x - x.mean(0), y - y.mean(0)
    coefficients, w_all, p_all, q_all = np.zeros((x.shape[1], y.shape[1])), [], [], []
    for _ in range(a):
        u = y[:, [int(np.argmax(y.var(0)))]]
        for _ in range(500):
            w = x.T @ u
            w /= np.linalg.norm(w)
            t = x @ w
            q = y.T @ t / (t.T @ t)
            u = y @ q / (q.T @ q)
        p = x.T @ t / (t.T @ t)
        x, y = x - t @ p.T, y - t @ q.T
        w_all.append(w)
        p_all.append(p)
        q_all.append(q)
    w, p, q = (np.hstack(v) for v in (w_all, p_all, q_all))
    return w @ np.linalg.inv(p.T @ w) @ q.T


def test_pls_is_nipals(spark, spectra):
    rows, classes = latent.with_targets(spectra)
    m = moments(rows.withColumn("all", F.lit("all")), "all")["all"]
    x, f = _matrix(spectra)
    y = (f["label"].to_numpy()[:, None] == np.array(classes)).astype(float)
    for a in (1, 2, 3):
        np.testing.assert_allclose(latent.fit_pls(m, 60, 3).coefficients(a), _nipals(x, y, a), atol=1e-5)


def test_errors_from_moments(spark, spectra):
    rows = splits.hashed_folds(spectra, 4).withColumn("y", F.array("conc"))
    by = moments(rows, "fold")
    f = rows.orderBy("sample_id").toPandas()
    x, press = np.stack(f["x"]), 0.0
    for k in sorted(f["fold"].unique()):
        out = (f["fold"] == k).to_numpy()
        b = _nipals(x[~out], f[["conc"]].to_numpy()[~out], 2)
        e = f["conc"].to_numpy()[out] - ((x[out] - x[~out].mean(0)) @ b)[:, 0] - f["conc"][~out].mean()
        press += (e**2).sum()
    assert latent.lv_curve(rows, 60, 2)[1][1] == pytest.approx(np.sqrt(press / len(f)), rel=1e-5)
    assert len(by) == len(f["fold"].unique())


def test_pca(spark, spectra):
    x, _ = _matrix(spectra)
    pca = latent.fit_pca(moments(spectra.withColumn("y", F.array(F.lit(0.0))).withColumn("all", F.lit("a")), "all")["a"], 60, 3)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    np.testing.assert_allclose(pca.variance, s[:3] ** 2 / (len(x) - 1), rtol=1e-8)
    q = np.array([r[0] for r in spectra.orderBy("sample_id").select(pca.q(F.col("x"))).collect()])
    t = (x - x.mean(0)) @ pca.loadings
    np.testing.assert_allclose(q, ((x - x.mean(0)) ** 2).sum(1) - (t**2).sum(1), atol=1e-9)


def test_savgol_on_polynomials():
    k = R.savgol_kernel(30, 7, 2, 1)
    x = np.arange(30.0)
    np.testing.assert_allclose((3 + 2 * x + 0.5 * x**2) @ k, 2 + x, atol=1e-9)


def test_folds_keep_replicates(spark, spectra):
    folded = spectra.join(splits.grouped_folds(spectra, 5), "group_id")
    assert splits.leaks(folded).count() == 0
    assert splits.leaks(spectra.withColumn("fold", F.col("sample_id") % 7)).count() > 0
    n = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert max(n) - min(n) <= 3
    with pytest.raises(ValueError):
        splits.grouped_folds(spectra, 1000)


def test_classification_finds_the_classes(spark, spectra):
    rows, classes = latent.with_targets(spectra.join(splits.grouped_folds(spectra, 5), "group_id"))
    s = metrics.summary(latent.out_of_fold(rows, classes, 60, 3)).first()
    assert s["accuracy"] == 1.0 and s["kappa"] == 1.0


def test_one_class(spark, spectra):
    models, refused = oneclass.fit(spectra, 2)
    assert not refused
    d = oneclass.decide(spectra, models).groupBy("label", "decision").count().collect()
    assert sum(r["count"] for r in d if r["decision"] not in (r["label"], "unknown", "ambiguous")) == 0
    assert sum(r["count"] for r in d if r["decision"] == r["label"]) >= 70


def test_permutation_and_quantiles(spark, spectra):
    r = validation.permutation_test(spectra, ["C0", "C1", "C2"], 2, folds=4, rounds=19).first()
    assert r["p_value"] == pytest.approx(0.05) and r["observed"] == 1.0 and r["n_valid"] == 19
    assert quantiles.f(spark, 0.95, 3, 20) == pytest.approx(3.0984, abs=1e-4)
    assert quantiles.chi2(spark, 0.95, 3.7) == pytest.approx(8.9971, abs=1e-4)
    assert resampling.cv_anova(spark, 10.0, 4.0, 20, 3)["f"] == pytest.approx((6 / 3) / (4 / 17))
    assert resampling.cv_anova(spark, 0.0, 0.0, 20, 3)["p"] == 1.0 and resampling.cv_anova(spark, 1.0, 2.0, 20, 3)["f"] == 0.0


def test_calibration_and_limits(spark, spectra):
    one = splits.hashed_folds(spectra.where("label = 'C1'"), 4)
    out, _, b = quantify.calibrate(one)
    assert metrics.regression(out).first()["r2"] > 0.95
    assert quantify.merit(one, b)["loq"] > quantify.merit(one, b)["lod"] > 0
    assert quantify.merit(one.dropDuplicates(["group_id"]), b)["lod"] is None


def test_conformal_refuses(spark):
    s = spark.createDataFrame([(f"g{i // 2}", float(i)) for i in range(12)], "group_id string, score double")
    assert oneclass.conformal_threshold(s, 0.05).first()["threshold"] is None
    assert oneclass.conformal_threshold(s, 0.2).first()["threshold"] == 10.5 - 0.0
    assert oneclass.needed_for_alpha(0.05) == 19


def test_nonfinite_and_constant(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, float("nan")]), (3, [1.0, float("inf")]), (4, [1.0, None])], "sample_id long, x array<double>")
    assert [r[0] for r in quality.drop_nonfinite(rows).select("sample_id").collect()] == [1]
    assert {r["j"]: r["constant"] for r in quality.constant_columns(rows.where("sample_id < 2")).collect()} == {0: True, 1: True}


@pytest.mark.parametrize(("line", "want"), [("100ABC", (100.0, [1, 2, 3])), ("0abc", (0.0, [-1, -2, -3])), ("0A23", (0.0, [123])), ("0AJ", (0.0, [1, 2])), ("0Ej", (0.0, [5, 4])), ("0CT", (0.0, [3, 3])), ("0CU", (0.0, [3, 3, 3])), ("-50A", (-50.0, [1]))])
def test_compressed_lines(line, want):
    assert readers.decode_line(line) == want


def test_files(spark, tmp_path):
    (tmp_path / "oil").mkdir()
    (tmp_path / "oil/a.dx").write_text("##TITLE=AND-04-11-2020-T1\n##XFACTOR=1\n##YFACTOR=0.5\n##FIRSTX=100\n##LASTX=105\n##NPOINTS=6\n##XYDATA=(X++(Y..Y))\n100ABC\n103DEF\n##END=\n")
    (tmp_path / "oil/b.txt").write_text("header\n4000,0;0,5\n4001,0;0,25\n")
    (tmp_path / "oil/c.dx").write_bytes(b"\x00\x01binary")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in readers.read(spark, "spectra", str(tmp_path)).collect()}
    assert rows["a.dx"]["x"] == [0.5, 1.0, 1.5, 2.0, 2.5, 3.0] and rows["a.dx"]["wn"][-1] == 105 and rows["a.dx"]["folder"] == "oil"
    assert rows["b.txt"]["x"] == [0.5, 0.25]
    assert rows["c.dx"]["error"]
    (tmp_path / "w.csv").write_text("name;kind;conc;1100.0;1102,5\ns1;A;0,5;1,0;2,0\ns2;B;;3.0;4.0\n")
    got = readers.read(spark, "csv", str(tmp_path / "w.csv"), label="kind", conc="conc").orderBy("name").collect()
    assert got[0]["x"] == [1.0, 2.0] and got[0]["wn"] == [1100.0, 1102.5] and got[0]["conc"] == 0.5 and got[1]["conc"] is None
    with pytest.raises(ValueError, match="csv, images, spectra, synthetic"):
        readers.read(spark, "nothing")


def test_scoring_in_batch_and_stream(spark, spectra, tmp_path):
    package = scoring.train_package(spectra, 3)
    scoring.save(spark, package, str(tmp_path / "model"))
    loaded = scoring.load(spark, str(tmp_path / "model"))
    batch = scoring.score(spectra, loaded)
    assert batch.where("predicted = label").count() == 90
    spectra.write.parquet(str(tmp_path / "in"))
    stream = scoring.score(spark.readStream.schema(spectra.schema).parquet(str(tmp_path / "in")), loaded)
    q = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("scored").where("predicted = label").count() == 90
    with pytest.raises(ValueError):
        scoring.score(spectra, {k: v for k, v in package.items() if k != "q_limit"})


def test_near_duplicates_of_many_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 20))
    x[600:] = x[:100] + rng.standard_normal((100, 20)) * np.linspace(0.001, 0.02, 100)[:, None]
    for least in (0.99995, 0.9):
        r = np.corrcoef(x)
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(r > least, 1)), strict=True)}
        got = [(r["a"], r["b"]) for r in quality.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, x array<double>"), least).collect()]
        assert len(got) == len(want) and set(got) == want and want
