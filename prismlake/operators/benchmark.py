"""Other learners under the same splits: Spark's own classifiers and regressions beside PLS."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import rowlocal as R
from prismlake.functions.ranks import signed_rank
from prismlake.operators import diagnostics, kernel, latent, metrics, pipeline, quantify, splits
from prismlake.operators.gram import Moments, channels

#: name: a function that makes the learner. More can be put in.
CLASSIFIERS = {
    "logistic": lambda: LogisticRegression(regParam=0.01, maxIter=50),
    "random_forest": lambda: RandomForestClassifier(numTrees=30, maxDepth=6, seed=42),
}
#: Needs a fit for each class; for few classes.
SLOW_CLASSIFIERS = {
    "linear_svc": lambda: OneVsRest(classifier=LinearSVC(regParam=0.01, maxIter=30)),
    "boosted_trees": lambda: OneVsRest(classifier=GBTClassifier(maxIter=50, stepSize=0.05, maxDepth=3, subsamplingRate=0.8, seed=42)),
}
#: Ridge, lasso and elastic net by Spark's penalty (of standardised columns).
REGRESSORS = {
    "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
    "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0),
    "elastic_net": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.5),
    "random_forest": lambda: RandomForestRegressor(numTrees=30, maxDepth=6, seed=42),
    "boosted_trees": lambda: GBTRegressor(maxIter=30, maxDepth=3, seed=42),
}


def classifiers(spectra: DataFrame, components: int, folds: int = 3, learners: dict | None = None, steps: pipeline.Steps | None = None) -> DataFrame:
    """model, balanced_accuracy, balanced_accuracy_sd, f1, f1_sd (over folds), p_value (signed ranks of the folds'
    balanced accuracies against PLS-DA's; null for it, and where no fold differs), seconds, note.

    PLS-DA, a support-vector machine with a Gaussian kernel and each learner, under the same hashed folds of
    groups. steps: a preprocessing whose learned states PLS-DA takes from the training folds; the other learners
    see x as it is. A learner that fails has null figures and its error in `note`."""
    spark = spectra.sparkSession
    every = {}
    out = []
    for name, predicted, began in out_of_fold(spectra, components, folds, learners, steps):
        try:
            cells = predicted.groupBy("fold", "label", "predicted").agg(F.count("*").alias("n")).toPandas() if isinstance(predicted, DataFrame) else None
            every[name] = fold_figures(cells) if cells is not None else predicted
        except Exception as e:  # a learner that can't be fitted is a row of the result, not the end of it
            every[name] = str(e).splitlines()[0][:200]
        seconds = time.monotonic() - began
        if isinstance(every[name], str):
            out.append((name, None, None, None, None, None, seconds, every[name]))
            continue
        accuracy, f1 = every[name]
        reference = every.get("pls_da")
        test = signed_rank(reference[0], accuracy) if name != "pls_da" and not isinstance(reference, str) else None
        out.append((name, float(np.mean(accuracy)), float(np.std(accuracy)), float(np.mean(f1)), float(np.std(f1)), test[1] if test else None, seconds, None))
    return spark.createDataFrame(out, "model string, balanced_accuracy double, balanced_accuracy_sd double, f1 double, f1_sd double, p_value double, seconds double, note string")


def fold_figures(cells: pd.DataFrame) -> tuple[list[float], list[float]]:
    """(balanced accuracies, macro F1) by fold from counts by fold, label and predicted class. F1 runs over the
    classes that a fold has or names."""
    accuracy, f1 = [], []
    for _, part in cells.groupby("fold"):
        names = sorted(set(part["label"]) | set(part["predicted"].dropna()))
        table = np.zeros((len(names),) * 2)
        for r in part.itertuples(index=False):
            if r.predicted is not None:
                table[names.index(r.label), names.index(r.predicted)] += r.n
        there, named, hit = table.sum(1), table.sum(0), np.diag(table)
        accuracy.append(float((hit[there > 0] / there[there > 0]).mean()))
        f1.append(float((2 * hit / np.maximum(there + named, 1)).mean()))
    return accuracy, f1


def out_of_fold(spectra: DataFrame, components: int, folds: int = 3, learners: dict | None = None, steps: pipeline.Steps | None = None) -> Iterator[tuple[str, DataFrame | str, float]]:
    """(name, rows of sample_id, label, fold, predicted, probability or the error, when it began) of each machine.
    probability: shares of the classes, in the order of their names."""
    folded, classes = latent.with_targets(splits.hashed_folds(spectra.where("x is not null and label is not null"), folds))
    columns = ("sample_id", "label", "fold", "predicted", "probability")
    began = time.monotonic()
    pls = pipeline.out_of_fold(folded, classes, steps or pipeline.Steps(("center",)), components)
    yield "pls_da", pls.withColumn("probability", R.clip_normalize(F.col("scores"))).select(*columns), began
    began = time.monotonic()
    try:
        p = channels(folded)
        m = diagnostics.whole(folded)
        fourier = kernel.Fourier.of(m.centred()[0][:p], kernel.scale_gamma(m, p))
        signed = folded.withColumn("y", F.transform("y", lambda v: 2 * v - 1))
        machines = kernel.newton(signed, fourier, list(range(folds)), len(classes), None)
        svm = kernel.scores(folded.select("sample_id", "label", "fold", "x"), fourier, machines, len(classes))
        yield "svm_rbf", svm.select("sample_id", "label", "fold", latent.predicted_class("scores", classes).alias("predicted"), R.softmax(F.col("scores")).alias("probability")), began
    except Exception as e:
        yield "svm_rbf", str(e).splitlines()[0][:200], began
    index = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc").fit(folded)
    rows = index.transform(folded.withColumn("features", array_to_vector("x"))).cache()
    for name, make in (CLASSIFIERS if learners is None else learners).items():
        began, parts = time.monotonic(), None
        try:
            for k in range(folds):
                model = make().setLabelCol("target").setFeaturesCol("features").fit(rows.where(F.col("fold") != k))
                scored = model.transform(rows.where(F.col("fold") == k))
                shares = vector_to_array("probability") if "probability" in scored.columns else F.lit(None).cast("array<double>")
                got = scored.select("sample_id", "label", "fold", F.get(F.lit(index.labels), F.col("prediction").cast("int")).alias("predicted"), shares.alias("probability"))
                parts = got if parts is None else parts.unionAll(got)
            yield name, parts, began
        except Exception as e:
            yield name, str(e).splitlines()[0][:200], began
    rows.unpersist()


def regressors(parted: DataFrame, components: int, learners: dict | None = None, by_class: bool = False) -> DataFrame:
    """model, n, rmse, r2, bias, sep, rpd, rer on the validation part, all fitted on the calibration part: PLS, a
    support-vector regression with a Gaussian kernel, and each learner. by_class: a model and a row for each
    label that has rows of both parts."""
    rows = quantify.known(parted).where("x is not null")
    if by_class:
        both = rows.where("label is not null").groupBy("label").agg(F.count_if(F.col("part") == "calibration").alias("a"), F.count_if(F.col("part") == "validation").alias("b"))
        out = None
        for r in both.where("a > 2 and b > 0").orderBy("label").collect():
            one = regressors(rows.where(F.col("label") == r["label"]), components, learners).withColumn("label", F.lit(r["label"]))
            out = one if out is None else out.unionAll(one)
        if out is None:
            raise ValueError("no class has rows of both parts")
        return out
    rows = rows.withColumn("features", array_to_vector("x")).cache()
    train, held = rows.where("part = 'calibration'"), rows.where("part = 'validation'")
    p = channels(train)
    m = diagnostics.whole(train, F.array("conc"))
    pls = latent.fit_pls(m, p, components)
    every = held.select(F.lit("pls").alias("model"), F.col("conc").alias("y"), pls.predict(F.col("x"), pls.w.shape[1])[0].alias("predicted"))
    every = every.unionAll(_svr(train, held, m, p))
    for name, make in (REGRESSORS if learners is None else learners).items():
        model = make().setLabelCol("conc").setFeaturesCol("features").fit(train)
        every = every.unionAll(model.transform(held).select(F.lit(name), "conc", F.col("prediction")))
    return metrics.regression(every, "model")


def _svr(train: DataFrame, held: DataFrame, m: Moments, p: int) -> DataFrame:
    """model, y, predicted of a support-vector regression of conc in units of its deviation."""
    mean = m.total[p] / m.n
    sd = float(np.sqrt(max(m.cross[p, p] / m.n - mean * mean, 0))) or 1.0
    fourier = kernel.Fourier.of(m.total[:p] / m.n, kernel.scale_gamma(m, p))
    one = train.select(F.lit(0).alias("fold"), "x", F.array((F.col("conc") - float(mean)) / sd).alias("y"))
    machine = kernel.newton(one, fourier, [None], 1, epsilon=0.1)
    scored = kernel.scores(held.select("conc", "x"), fourier, machine, 1)
    return scored.select(F.lit("svr_rbf"), "conc", F.get("scores", F.lit(0)) * sd + float(mean))
