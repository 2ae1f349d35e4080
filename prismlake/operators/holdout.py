"""An external hold-out: rows set aside before anything is fitted, and what they say beside cross-validation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions.ordering import by_hash, numbered
from prismlake.operators import latent, pipeline, splits
from prismlake.operators.validation import balanced_accuracy, confusion, effective_splits


def set_aside(spectra: DataFrame, share: float = 0.2, seed: int = 42, keep_pure: bool = False, groups: bool = True) -> DataFrame:
    """spectra with part: `holdout` or `train`.

    With groups, ceil(share) of the groups in the order of a hash are held out, so that replicates stay together;
    without, ceil(share) of each class's rows (stratified). keep_pure: rows without any adulterant (conc 0 or
    unknown) are not drawn and stay in training; a group is drawn if any of its rows may be. Rows without a
    group, or without a label where classes are drawn, stay in training too."""
    eligible = spectra.where("conc > 0") if keep_pure else spectra
    if groups:
        g = eligible.where("group_id is not null").select("group_id").distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "group_id")))
        n = g.agg(F.ceil(F.count("*") * share).alias("_take"))
        drawn = numbered(g, by_hash(F.col("_h")), "_h", "group_id").crossJoin(F.broadcast(n)).where(F.col("rank") <= F.col("_take")).select("group_id", F.lit("holdout").alias("part"))
        return spectra.join(drawn, "group_id", "left").withColumn("part", F.coalesce("part", F.lit("train")))
    rows = eligible.where("label is not null").select("sample_id", "label", F.md5(F.concat(F.lit(f"{seed}:"), F.col("sample_id").cast("string"))).alias("_h"))
    n = rows.groupBy("label").agg(F.ceil(F.count("*") * share).alias("_take"))
    drawn = numbered(rows, by_hash(F.col("_h")), "_h", "sample_id", keys=("label",)).join(n, "label").where(F.col("rank") <= F.col("_take")).select("sample_id", F.lit("holdout").alias("part"))
    return spectra.join(drawn, "sample_id", "left").withColumn("part", F.coalesce("part", F.lit("train")))


def figures(counts: np.ndarray) -> dict[str, float]:
    """accuracy, balanced_accuracy, f1 (macro) and kappa of a table of counts by (label, predicted)."""
    n, there, named, hit = counts.sum(), counts.sum(1), counts.sum(0), np.diag(counts)
    accuracy, chance = hit.sum() / n, float((there * named).sum()) / n**2
    seen = (there + named) > 0
    return {"accuracy": float(accuracy), "balanced_accuracy": balanced_accuracy(counts), "f1": float((2 * hit[seen] / (there + named)[seen]).mean()), "kappa": float((accuracy - chance) / (1 - chance)) if chance < 1 else 0.0}


def report(parted: DataFrame, steps: pipeline.Steps, most: int = 10, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(table, comparison). table: label, predicted, n, share (of the label) of the held-out rows. comparison: metric,
    cross_validated (folds within the training part), holdout.

    Components are chosen, states learned and the model fitted on the training part alone. Without held-out or
    without training rows: ValueError."""
    spark = parted.sparkSession
    rows, classes = latent.with_targets(parted.where("label is not null and x is not null"))
    n = rows.agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "holdout").alias("holdout")).first()
    if not n["train"] or not n["holdout"]:
        raise ValueError("a hold-out needs rows of both parts")
    train = rows.where("part = 'train'")
    folded = splits.hashed_folds(train, effective_splits(train, folds))
    states = pipeline.learned_states(folded, steps)
    parts = pipeline.fold_moments(folded, steps, states)
    a = latent.choose_lv(pipeline.curve(parts, len(classes), most))
    inner = confusion(pipeline.out_of_fold(folded, classes, steps, a, states, parts), classes)
    # the held-out part is one fold, of which all training rows are the others
    two = rows.withColumn("fold", (F.col("part") == "holdout").cast("int"))
    outside = pipeline.learned_states(two, steps)
    both = pipeline.fold_moments(two, steps, outside)
    held = pipeline.out_of_fold(two.where("fold = 1"), classes, steps, a, outside, both)
    outer = confusion(held, classes)
    cells = [(classes[i], classes[j], int(outer[i, j]), float(outer[i, j] / max(outer[i].sum(), 1))) for i in range(len(classes)) for j in range(len(classes))]
    f, g = figures(inner), figures(outer)
    return spark.createDataFrame(cells, "label string, predicted string, n long, share double"), spark.createDataFrame([(k, f[k], g[k]) for k in f], "metric string, cross_validated double, holdout double")
