"""Scoring of new samples, from a batch or a stream: row-local, so one function serves both."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions import quantiles
from prismlake.functions import rowlocal as R
from prismlake.operators.diagnostics import loo_q, moments_dof, q_limit
from prismlake.operators.gram import channels, moments
from prismlake.operators.latent import Pca, Pls, fit_pca, fit_pls, predicted_class, with_targets


def train_package(spectra: DataFrame, components: int, alpha: float = 0.05) -> dict:
    """A fitted model as plain numbers: JSON, no code. The scale, freedom and limit of its combined distance come
    with it, of leave-one-out Q, and limits of T2 and Q."""
    spark = spectra.sparkSession
    rows, classes = with_targets(spectra)
    p = channels(spectra)
    m = next(iter(moments(rows.withColumn("all", F.lit("all")), "all").values()))
    pls, pca = fit_pls(m, p, components), fit_pca(m, p, components)
    judged = loo_q(spectra.select("x").withColumn("all", F.lit("all")), "all", {"all": m.subset(np.arange(p + 1))}, pca.loadings.shape[1]).select(pca.t2(F.col("x")).alias("t2"), F.col("q_loo").alias("q"))
    r = judged.agg(F.avg("t2").alias("h0"), F.stddev_samp("t2").alias("hs"), F.avg("q").alias("q0"), F.stddev_samp("q").alias("qs")).first()
    nh, nq = moments_dof(r["h0"], r["hs"]), moments_dof(r["q0"], r["qs"])
    package = {"classes": classes, "n_train": m.n, "t2_limit": quantiles.hotelling_limit(spark, int(m.n), pca.loadings.shape[1], alpha), "q_limit": q_limit(spark, judged, "q", alpha)}
    package |= {"h0": r["h0"], "q0": r["q0"] or 0.0, "nh": nh, "nq": nq, "distance_limit": quantiles.chi2(spark, 1 - alpha, nh + nq)}
    package["pls"] = {k: np.asarray(v).tolist() for k, v in vars(pls).items()}
    package["pca"] = {k: np.asarray(v).tolist() for k, v in vars(pca).items()}
    return package


def save(spark: SparkSession, package: dict, path: str) -> None:
    """One row: the JSON and its SHA-256."""
    text = json.dumps(package, sort_keys=True)
    spark.createDataFrame([(text,)], "model string").withColumn("sha256", F.sha2("model", 256)).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict:
    row = spark.read.parquet(path).withColumn("good", F.sha2("model", 256) == F.col("sha256")).first()
    if row is None or not row["good"]:
        raise ValueError(f"the model in {path} does not match its checksum")
    return json.loads(row["model"])


def score(rows: DataFrame, package: dict) -> DataFrame:
    """rows with predicted, confidence, t2, q, distance, t2_ok, q_ok, accepted. Refuses a package without limits.

    A sample is accepted by its combined distance t2 / h0 nh + q / q0 nq, whose scale and freedom come from the
    training rows' T2 and leave-one-out Q; the two limits of one axis only tell which distance stands out. A row
    without x has nulls."""
    if missing := {"q_limit", "t2_limit", "distance_limit", "h0", "q0", "nh", "nq"} - set(package):
        raise ValueError(f"the model has no training limits: {', '.join(sorted(missing))}")
    pls = Pls(**{k: np.array(v) for k, v in package["pls"].items()})
    pca = Pca(**{k: np.array(v) if k != "total" else v for k, v in package["pca"].items()})
    a = pls.w.shape[1]
    out = rows.withColumn("scores", pls.predict(F.col("x"), a)).withColumn("t2", pca.t2(F.col("x"))).withColumn("q", pca.q(F.col("x")))
    out = out.withColumn("distance", F.col("t2") / max(package["h0"], 1e-12) * package["nh"] + F.col("q") / max(package["q0"], 1e-12) * package["nq"])
    out = out.withColumn("predicted", predicted_class("scores", package["classes"])).withColumn("confidence", F.array_max(R.softmax(F.col("scores"))))
    out = out.withColumn("t2_ok", F.col("t2") <= package["t2_limit"]).withColumn("q_ok", F.col("q") <= package["q_limit"])
    return out.withColumn("accepted", F.col("distance") <= package["distance_limit"]).drop("scores")
