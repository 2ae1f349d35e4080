"""pyspark.ml stages and settings."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from prismlake import config, ml
from prismlake.functions import rowlocal as R
from prismlake.sources import readers


def test_stages_in_a_pipeline(spark, tmp_path):
    e = readers.read(spark, "synthetic", channels=20)
    fitted = Pipeline(stages=[ml.Snv(), ml.SavGol(window=7), ml.Msc(), ml.PlsDa(components=3)]).fit(e)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    out = PipelineModel.load(str(tmp_path / "model")).transform(e)
    assert out.where("predicted = label").count() == 90
    assert out.select(F.max(F.abs(R.total(F.col("probability")) - 1))).first()[0] < 1e-9
    x = np.array(e.orderBy("sample_id").first()["x"])
    got = ml.SavGol(window=7).transform(e).orderBy("sample_id").first()["x"]
    np.testing.assert_allclose(got, x @ R.savgol_kernel(20, 7), atol=1e-12)


def test_settings(spark, tmp_path):
    s, errors = config.check({"windw": 7, "folds": "3", "alpha": 2, "mode": "tape", "wn_min": 5, "wn_max": 4, "window": 4})
    assert len(errors) == 6 and "did you mean 'window'" in errors[0]
    good = config.Settings(window=11, wn_min=4000.0)
    config.save(spark, good, str(tmp_path / "s"))
    assert config.load(spark, str(tmp_path / "s")) == good
    profiles = {"oil": {"window": 7, "alpha": 0.01}}
    assert config.apply_profile(good, profiles, "oil") == config.Settings(window=11, wn_min=4000.0, alpha=0.01)
    with pytest.raises(ValueError, match="oil"):
        config.apply_profile(good, profiles, "none")
    assert config.fingerprint(spark, good) != config.fingerprint(spark, config.Settings())


def test_sinks(spark, tmp_path):
    from prismlake import sinks

    t = spark.createDataFrame([("a", [1.0, 2.5]), ("b", None)], "k string, x array<double>")
    (path,) = sinks.write_tables({"t": t}, str(tmp_path))
    assert {(r["k"], r["x"]) for r in spark.read.csv(path, header=True).collect()} == {("a", "1.0 2.5"), ("b", None)}
    card = sinks.model_card(spark.createDataFrame([("q2", 0.5), ("accuracy", None)], "key string, value double"), "Oils", ["from one year"], True).first()[0]
    assert "| q2 | 0.5" in card and "| accuracy | n/a |" in card and "Prototype" in card and card.endswith("- from one year")
    m = sinks.manifest(spark, spark.createDataFrame([("{}",)], "model string"), ["a"], 3).first()[0]
    assert '"classes":["a"]' in m and "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a" in m
    assert sinks.output_name("Oil / NIR 2", 4, "abcdef0123") == "oil-nir-2-s4-abcdef01"


def test_group_key_is_that_of_the_parsed_title(spark):
    from pyspark.sql import functions as F

    from prismlake.functions import titles

    names = ["FAB-01-02-2020-T1", " PAB_01-02-2020-AD-A-7,5%%T_2 ", "FAB-01-02-2020-AD-S-0%-T1", "Fab-01-02-2020-T1", "FAB-01-02-2020-T4", "FAB-01-02-2020-AD-M-39,00%_T3", "a\x01b\x01c\x01d\x01e", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "title string")
    got = rows.select(titles.group_key(F.col("title")).alias("a"), titles.parse_title(F.col("title"))["group_id"].alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and sum(r["a"] is not None for r in got) == 3
