"""The data source of instrument files, the sanitised sink, and the gated run."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake import run, sinks
from prismlake.config import Settings
from prismlake.operators import holdout, pipeline, preprocess, quantify
from prismlake.sources import datasource, folders, readers


def dx(title, n=5, owner="me"):
    lines = "".join(f"{100 + k} {k}\n" for k in range(n))
    return f"##TITLE= {title}\n##JCAMP-DX=4.24\n##AUDIT TRAIL= a\n( 1, who, where)\n##OWNER={owner}\n##XFACTOR=1\n##YFACTOR=1\n##FIRSTX=100\n##LASTX={99 + n}\n##NPOINTS={n}\n##XYDATA=(X++(Y..Y))\n{lines}##END=\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for d in ("a", "b/c"):
        (root / d).mkdir(parents=True)
    (root / "a/one.dx").write_text(dx("AND-04-11-2020-T1", 50_000))
    (root / "a/two.DX").write_text(dx("AND-04-11-2020-T2"))
    (root / "b/c/three.txt").write_text("x y\n1 2\n3 4\n")
    (root / "b/c/four.jdx").write_text("no labels at all")
    (root / "b/five.dx").write_bytes(b"\x00\x01\x02")
    (root / "b/six.spectrum").write_bytes("Bomem File".encode("utf-16-le") + b"\x00" * 50)
    (root / "b/seven.sp.csv").write_bytes(b"PEPE" + b"\x01\x02" * 50)
    (root / "b/read.me").write_text("not a spectrum")
    return root


def test_whole_files(spark, tree):
    datasource.register(spark)
    got = {r["path"].rsplit("/", 1)[1]: r for r in spark.read.format("spectra").load(str(tree)).collect()}
    assert set(got) == {"one.dx", "two.DX", "three.txt", "four.jdx", "five.dx", "six.spectrum", "seven.sp.csv"}
    assert got["two.DX"]["x"] == [0, 1, 2, 3, 4] and got["two.DX"]["wn"][-1] == 104 and got["two.DX"]["title"] == "AND-04-11-2020-T2" and got["two.DX"]["folder"] == "a"
    assert got["three.txt"]["x"] == [2, 4] and got["three.txt"]["folder"] == "c" and len(got["one.dx"]["x"]) == 50_000
    assert "Bomem" in got["six.spectrum"]["error"] and "PerkinElmer" in got["seven.sp.csv"]["error"] and "binary" in got["five.dx"]["error"] and got["four.jdx"]["error"]
    same = {r["path"].rsplit("/", 1)[1]: r for r in readers.read_spectra(spark, str(tree)).collect()}
    assert all(same[n]["x"] == got[n]["x"] and bool(same[n]["error"]) == bool(got[n]["error"]) for n in got)


def test_a_prescan_opens_no_data(spark, tree):
    """A schema without wn and x reads blocks up to the data only: 600 kB of them stay unread."""
    h = {r["path"].rsplit("/", 1)[1]: r for r in folders.headers(spark, str(tree)).collect()}
    assert set(h) == {"one.dx", "two.DX", "five.dx"}
    size = os.path.getsize(tree / "a/one.dx")
    assert size > 500_000 and h["one.dx"]["bytes_read"] <= datasource.BLOCK and h["one.dx"]["last_x"] == 50_099 and h["one.dx"]["title"] == "AND-04-11-2020-T1"
    asked = spark.read.format("spectra").option("headers", "true").load(str(tree)).where("title is not null").select("n_points", "x").collect()
    assert {(r["n_points"], r["x"]) for r in asked} == {(50_000, None), (5, None)}


def test_empty_folder(spark, tmp_path):
    datasource.register(spark)
    assert spark.read.format("spectra").load(str(tmp_path)).count() == 0


def test_sanitised_copies(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(6):
        (source / f"secret{i}.dx").write_text(dx(f"AND-0{i // 2 + 1}-11-2020-T{i % 2 + 1}"))
    n = folders.sanitise_folder(spark, str(source), str(target), "key").first()
    assert (n["n_files"], n["n_dropped"]) == (6, 18)
    files = sorted(os.listdir(target))
    assert len(files) == 6 and all(f.endswith(".dx") and len(f) == 19 for f in files) and not any("secret" in f for f in files)
    got = spark.read.format("spectra").load(str(target))
    assert got.where("error is null and size(x) = 5").count() == 6 and got.select("title").distinct().count() == 6 and got.select(F.substring_index("title", "-", 1)).distinct().count() == 3
    assert not any(w in (target / f).read_text() for f in files for w in ("OWNER", "AUDIT", "who", "AND-"))
    # another key gives other names and titles; the same one refuses to write over what is there
    folders.sanitise_folder(spark, str(source), str(tmp_path / "other"), "key2")
    assert not set(files) & set(os.listdir(tmp_path / "other"))
    with pytest.raises(Exception, match="exist already"):
        folders.sanitise_folder(spark, str(source), str(target), "key")
    assert sorted(os.listdir(target)) == files


def test_a_copy_that_names_its_origin_stops_all(spark, tmp_path):
    lines = spark.createDataFrame([("a", 0, "##TITLE=x"), ("b", 0, "fine"), ("b", 1, "## OWNER = somebody")], "name string, n long, line string").repartition(2)
    with pytest.raises(Exception, match="name their origin"):
        datasource.write_sanitised(lines, str(tmp_path / "out"), "key")
    assert os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="key"):
        datasource.write_sanitised(lines, str(tmp_path / "out"), "")
    datasource.write_sanitised(lines.limit(0), str(tmp_path / "out"), "key")
    assert os.listdir(tmp_path / "out") == []


def test_preview_and_tecator(spark, tmp_path):
    (tmp_path / "w.csv").write_text("kind;100;101;102,5\nA;1;2;3\nB;4;5;6\nC;7;8;9\n")
    got = [(r["label"], r["wn"], r["x"]) for r in readers.preview_csv(spark, str(tmp_path / "w.csv"), "kind", 100.5, 200, 2).collect()]
    assert sorted(got) == [("A", [101, 102.5], [2, 3]), ("B", [101, 102.5], [5, 6])]
    assert readers.preview_csv(spark, str(tmp_path / "w.csv"), lo=500, hi=600).first()["x"] == []
    sample = lambda i: "".join(" ".join(str(i + 5 * r + c) for c in range(5)) + "\n" for r in range(20)) + "0 0 0 0 0\n" * 4 + f"0 0 {60 + i} {i} 20\n"
    text = "prose extrapolation_examples=25 prose\nextrapolation_examples=25\n\n" + "".join(sample(i) for i in range(220))
    (tmp_path / "tecator").write_text(text)
    rows = readers.read_tecator(spark, str(tmp_path / "tecator")).orderBy("sample_id").collect()
    assert len(rows) == 220 and rows[3]["x"] == [3.0 + k for k in range(100)] and (rows[3]["conc"], rows[3]["moisture"], rows[3]["protein"]) == (3, 63, 20) and rows[0]["wn"][-1] == 1050
    assert [sum(r["part"] == p for r in rows) for p in ("train", "test", "extrapolation")] == [172, 43, 5]
    for bad in ("nothing", text + "1 2\n", text.replace("0 1 2 3 4\n", "0 1 2 3\n")):
        with pytest.raises(ValueError, match="data|lines|absorbances"):
            readers.decode_tecator(bad)


def test_blocks_are_appended(spark):
    card = sinks.model_card(spark.createDataFrame([("n", 3.0)], "key string, value double"), "Model")
    metrics = spark.createDataFrame([("b", 0.5, None), ("a", float("nan"), 2.0)], "model string, r2 double, rpd double")
    text = sinks.regression_block(card, metrics, spark.createDataFrame([("lod", 1.25)], "figure string, value double")).first()[0]
    assert text.startswith("# Model") and "## Regression\n\n| model | r2 | rpd |" in text
    assert text.index("| a | n/a | 2.00000 |") < text.index("| b | 0.500000 | n/a |")
    assert "## Figures of merit" in text and "| lod | 1.25" in text


# ------------------------------------------------------------------ the gated run

SCHEMA = "sample_id long, label string, conc double, group_id string, x array<double>"


@pytest.fixture(scope="module")
def spectra(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(72):
        k = i % 3
        conc = float(i // 12) * 2
        x = np.exp(-((np.linspace(0, 1, 50) - 0.3 - 0.1 * k) ** 2) / 0.02) * rng.uniform(0.5, 2) + 0.03 * rng.normal(size=50) + conc * 0.1 * np.sin(np.linspace(0, 5, 50))
        rows.append((i, f"c{k}", conc, f"g{k}-{i // 6}", x.tolist()))
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_one_call_gives_the_tables_of_an_objective(spectra, monkeypatch):
    calls = []
    real = pipeline.fold_moments
    monkeypatch.setattr(pipeline, "fold_moments", lambda *a, **k: calls.append(1) or real(*a, **k))
    made, notes = run.tables(spectra, Settings(window=7, folds=3, most_components=4, wn_min=105.0), wn=np.arange(100.0, 150.0))
    assert len(calls) == 1  # curve, predictions and what follows share the moments
    note = {r["result"]: r for r in notes.collect()}
    assert set(made) == {"component_curve", "predictions", "confusion", "summary", "roc", "vip_and_sr"} and not note["benchmark"]["made"] and "costly" in note["benchmark"]["note"]
    assert made["summary"].first()["balanced_accuracy"] > 0.9 and made["vip_and_sr"].count() == 45 and made["roc"].count() == 3


def test_what_cannot_be_had_has_a_note(spectra):
    one = spectra.where("label = 'c0'").withColumn("conc", F.lit(None).cast("double"))
    made, notes = run.tables(one, Settings(window=7), objective=run.QUANTIFICATION)
    assert not made and all("levels of concentration" in r["note"] for r in notes.collect())
    made, notes = run.tables(one, Settings(window=7), wanted=["summary", "mean_spectra", "class_tree"])
    note = {r["result"]: r["note"] for r in notes.collect()}
    assert set(made) == {"mean_spectra"} and "needs 2 classes" in note["summary"] and "needs 2 classes" in note["class_tree"] and note["roc"] == "not asked for"
    made, notes = run.tables(spectra.limit(0), objective=run.EXPLORATORY)
    assert not made and {r["note"] for r in notes.collect()} == {"no rows"}
    made, notes = run.tables(spectra, Settings(window=99), wanted=["summary"])
    assert not made and "window" in {r["result"]: r["note"] for r in notes.collect()}["summary"]
    with pytest.raises(ValueError, match="unknown results"):
        run.tables(spectra, wanted=["nothing"])


def test_exploratory_and_quantification(spectra):
    made, _ = run.tables(spectra, Settings(window=7, folds=3), objective=run.EXPLORATORY)
    assert made["pca_scores"].count() == 72 * 5 and made["class_tree"].count() == 2 and made["mean_spectra"].count() == 150
    made, _ = run.tables(spectra, Settings(preset="mc", folds=3), objective=run.QUANTIFICATION)
    assert made["calibration"].first()["r2"] > 0.8 and made["figures_of_merit"].count() >= 4


def test_holdout_report(spectra):
    """The held-out rows are those of the drawn groups, the model never sees them, and pure groups stay."""
    parted = holdout.set_aside(spectra, 0.25, keep_pure=True)
    n = {(r["part"], r["pure"]): r["n"] for r in parted.groupBy("part", (F.col("conc") == 0).alias("pure")).agg(F.count("*").alias("n")).collect()}
    assert ("holdout", True) not in n and n["holdout", False] >= 12
    assert parted.groupBy("group_id").agg(F.countDistinct("part").alias("k")).where("k > 1").count() == 0
    steps = pipeline.Steps(("msc", "savgol", "center"), 7)
    table, comparison = holdout.report(parted, steps, 4, 3)
    figures = {r["metric"]: (r["cross_validated"], r["holdout"]) for r in comparison.collect()}
    assert set(figures) == {"accuracy", "balanced_accuracy", "f1", "kappa"} and min(figures["balanced_accuracy"]) > 0.85
    assert table.agg(F.sum("n")).first()[0] == parted.where("part = 'holdout'").count()
    # shifting held-out rows changes nothing that was learned: cross-validated figures stay
    moved = parted.withColumn("x", F.when(F.col("part") == "holdout", F.transform("x", lambda v: v + 100 * F.rand(1))).otherwise(F.col("x")))
    again = {r["metric"]: r["cross_validated"] for r in holdout.report(moved, steps, 4, 3)[1].collect()}
    assert again == {k: v[0] for k, v in figures.items()}
    with pytest.raises(ValueError, match="both parts"):
        holdout.report(parted.withColumn("part", F.lit("train")), steps, 3, 3)
    strata = holdout.set_aside(spectra, 0.25, groups=False).where("part = 'holdout'").groupBy("label").count().collect()
    assert {r["count"] for r in strata} == {6}
    kept = quantify.processed_replicates(spectra, spectra, preprocess.preset("snv_sg_mc"), 7)
    assert kept.count() == 72 and quantify.replicate_noise(kept).first()["noise"] > 0
