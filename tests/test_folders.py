"""Folders of spectra and images, side tables, sanitising."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.sources import folders, images, readers


def _dx(title, first, last, values):
    step = (last - first) / (len(values) - 1)
    lines = "".join(f"{first + k * step:g} {v}\n" for k, v in enumerate(values))
    return f"##TITLE= {title}\n##JCAMP-DX=4.24\n##AUDIT TRAIL= a\n( 1, who, where)\n##$Detector Gain=1\n##OWNER=me\n##XFACTOR=1\n##YFACTOR=1\n##FIRSTX={first}\n##LASTX={last}\n##NPOINTS={len(values)}\n##XYDATA=(X++(Y..Y))\n{lines}##END=\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("spectra")
    for d in ("and", "cap"):
        (root / d).mkdir()
    (root / "and/a.dx").write_text(_dx("AND-04-11-2020-T1", 100, 104, [1, 2, 3, 4, 5]))
    (root / "and/b.dx").write_text(_dx("AND_04-11-2020T_2", 100, 108, [1, 3, 5]))
    (root / "and/c 4,50 %.dx").write_text(_dx("no title", 100, 104, [5, 4, 3, 2, 1]))
    (root / "cap/d.dx").write_text(_dx("CAP-05-11-2020-AD-S-4,13%-T1", 100, 104, [0, 1, 0, 1, 0]))
    (root / "cap/e.dx").write_text(_dx("CAP-05-11-2020-T1", 100, 900, [0, 1]))
    (root / "cap/f.dx").write_text(_dx("CAP-06-11-2020-T1", 100, 104, [0, 1, 0, 1, 0]))
    (root / "cap/g.dx").write_bytes(b"\x00\x01binary")
    return str(root)


def test_a_folder_is_one_table(spark, tree):
    names = spark.createDataFrame([("AND", "andiroba")], "code string, name string")
    unsure = spark.createDataFrame([("CAP-06-11-2020-T1", "purity unknown")], "title string, reason string")
    got, rejected, grid = folders.load(spark, tree, content_from_name=True, names=names, exclusions=unsure)
    rows = {r["path"].rsplit("/", 1)[1].replace("%20", " ").replace("%25", "%"): r for r in got.collect()}
    assert set(rows) == {"a.dx", "b.dx", "c 4,50 %.dx", "d.dx"} and list(grid) == [100, 101, 102, 103, 104]
    assert rows["a.dx"]["group_id"] == rows["b.dx"]["group_id"] == "AND-04-11-2020" and rows["a.dx"]["label"] == "andiroba"
    np.testing.assert_allclose(rows["b.dx"]["x"], [1, 1.5, 2, 2.5, 3])
    assert rows["c 4,50 %.dx"]["label"] == "and" and rows["c 4,50 %.dx"]["group_id"].startswith("orphan_")
    assert (rows["d.dx"]["label"], rows["d.dx"]["conc"], rows["d.dx"]["group_id"]) == ("CAP", 4.13, "CAP-05-11-2020-S4.13")
    why = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in rejected.collect()}
    assert why["e.dx"] == "out of range" and why["f.dx"] == "purity unknown" and set(why) == {"e.dx", "f.dx", "g.dx"}


def test_prescan_reads_headers(spark, tree):
    h = folders.headers(spark, tree)
    r = folders.prescan(h).first()
    assert (r["n_files"], r["n_no_header"], r["dominant"], r["n_out_of_range"], r["n_kept"], r["n_orphans"], r["n_groups"]) == (7, 1, 100.0, 1, 5, 1, 4)
    assert {x["folder"]: x["n"] for x in folders.out_of_range(h).collect()} == {"cap": 1}
    assert folders.preview(readers.read_spectra(spark, tree), 2).count() == 4


def test_provenance_goes(spark, tree):
    text = _dx("AND-04-11-2020-T1", 100, 104, [1, 2, 3, 4, 5]) + "##$ owner= x\nnext line\n\nkept\n##Comments=y\n"
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text.split("\n"))], "path string, n int, line string")
    assert folders.suspicious(lines).count() == 3
    kept = [r["line"] for r in folders.without_provenance(lines).orderBy("n").collect()]
    assert "##$Detector Gain=1" in kept and "kept" in kept and not {"( 1, who, where)", "##OWNER=me", "next line", "##Comments=y"} & set(kept)
    assert folders.suspicious(folders.without_provenance(lines)).count() == 0
    titles = spark.createDataFrame([("a", "##TITLE= X-1-T1"), ("b", "##TITLE=X-1_T2"), ("c", "##TITLE=Y-1-T1"), ("d", "##DX=1")], "path string, line string")
    new = {r["path"]: r["line"] for r in folders.anonymous_titles(titles).collect()}
    assert new["a"][:-3] == new["b"][:-3] != new["c"][:-3] and new["a"].endswith("-T1") and new["b"].endswith("-T2") and new["d"] == "##DX=1"


def _png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[i].tobytes() for i in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    for d in ("red", "mixed"):
        (tmp_path / d).mkdir()
    _png(tmp_path / "red/a.png", np.full((6, 5, 3), (255, 0, 0), np.uint8))
    half = np.zeros((4, 8, 3), np.uint8)
    half[:, 4:] = (0, 0, 255)
    _png(tmp_path / "mixed/b.png", half)
    (tmp_path / "mixed/broken.png").write_bytes(b"no image")
    got = {r["label"]: r for r in readers.read(spark, "images", str(tmp_path), texture=True).collect()}
    assert set(got) == {"red", "mixed"} and got["red"]["prototype"]
    f = dict(zip(images.COLOUR + images.TEXTURE, got["red"]["x"], strict=True))
    assert (f["R_mean"], f["G_mean"], f["H_mean"], f["S_mean"], f["V_mean"]) == (255, 0, 0, 1, 1) and f["R_sd"] == 0
    assert f["L_mean"] == pytest.approx(53.24, abs=0.02) and f["a_mean"] == pytest.approx(80.09, abs=0.02) and f["b_mean"] == pytest.approx(67.20, abs=0.02)
    assert f["glcm_contrast"] == 0 and f["glcm_energy"] == 1 and f["glcm_homogeneity"] == 1
    g = dict(zip(images.COLOUR + images.TEXTURE, got["mixed"]["x"], strict=True))
    assert g["B_mean"] == 127.5 and g["glcm_contrast"] == pytest.approx(18**2 / 7)
    right = {r["label"]: r for r in readers.read(spark, "images", str(tmp_path), box=(0.5, 0, 1, 1)).collect()}
    assert dict(zip(images.COLOUR, right["mixed"]["x"], strict=True))["B_mean"] == 255
    assert images.crop(half, (0.3, 0.3, 0.3, 0.9)).shape == half.shape
    hsv = images.to_hsv(np.array([[0.2, 0.4, 0.6], [0.6, 0.2, 0.4]]))
    import colorsys

    np.testing.assert_allclose(hsv, [colorsys.rgb_to_hsv(0.2, 0.4, 0.6), colorsys.rgb_to_hsv(0.6, 0.2, 0.4)])


def test_side_tables_override(spark):
    rows = spark.createDataFrame([("ABC-1-1-2020 T9",), ("AND-04-11-2020-T1",), ("x",)], "title string")
    fix = spark.createDataFrame([("ABC-1-1-2020 T9", "ABC", "01-01-2020", "A", 1.5, 2)], "title string, code string, date string, adulterant string, content double, replicate int")
    alias = spark.createDataFrame([("ABC-01-01-2020-A1.50", "G")], "source string, target string")
    got = {r["title"]: r for r in folders.resolve_titles(rows, corrections=fix, aliases=alias).collect()}
    assert got["ABC-1-1-2020 T9"]["group_id"] == "G" and got["ABC-1-1-2020 T9"]["valid"] and got["ABC-1-1-2020 T9"]["replicate"] == 2
    assert got["AND-04-11-2020-T1"]["group_id"] == "AND-04-11-2020" and not got["x"]["valid"] and got["x"]["group_id"] is None
    assert folders.resolve_titles(rows).where(F.col("excluded").isNotNull()).count() == 0
