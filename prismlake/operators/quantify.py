"""Calibration of concentration: pooled, per class, per class and adulterant; figures of merit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.functions import titles
from prismlake.operators import diagnostics, metrics
from prismlake.operators.gram import Moments, channels, moments
from prismlake.operators.latent import choose_lv, error_sum, fit_pls, lv_curve
from prismlake.schema import to_long

#: Where the class that a calibration sees comes from.
MODES = ("blind", "control")


def calibrate(folded: DataFrame, most: int = 8) -> tuple[DataFrame, int, np.ndarray]:
    """(sample_id, label, fold, y, predicted out of fold; components; coefficients of the whole set). Rows of
    an unknown concentration are left out."""
    p = channels(folded)
    rows = folded.where("conc is not null and not isnan(conc)").withColumn("y", F.array("conc"))
    a = choose_lv(lv_curve(rows, p, most), 0.0)
    by = moments(rows, "fold")
    total = sum(list(by.values())[1:], next(iter(by.values())))
    predicted = F.lit(None).cast("double")
    for k, m in by.items():
        predicted = F.when(F.col("fold").cast("string") == k, fit_pls(total - m, p, a).predict(F.col("x"), a)[0]).otherwise(predicted)
    out = rows.select("sample_id", "label", "group_id", "fold", F.col("y")[0].alias("y"), predicted.alias("predicted"))
    return out, a, fit_pls(total, p, a).coefficients(a)[:, 0]


def by_class(folded: DataFrame, components: int = 3, least: int = 6) -> DataFrame:
    """label, n, rmse, r2, ... of one calibration per class; classes under `least` rows are refused. One
    task per class works on that class's fold moments, not on its rows."""
    p = channels(folded)
    rows = folded.where("conc is not null and not isnan(conc)").withColumn("y", F.array("conc")).withColumn("key", F.concat_ws("|", "label", F.col("fold").cast("string")))
    by = moments(rows, "key")
    predicted = F.lit(None).cast("double")
    for label in sorted({k.rsplit("|", 1)[0] for k in by}):
        own = {k: m for k, m in by.items() if k.rsplit("|", 1)[0] == label}
        total = sum(list(own.values())[1:], next(iter(own.values())))
        if total.n < least:
            continue
        for k, m in own.items():
            rest = total - m
            if rest.n < 4:
                continue
            model = fit_pls(rest, p, min(components, max(1, int(rest.n) // 5)))
            if model.w.shape[1]:
                predicted = F.when(F.col("key") == k, model.predict(F.col("x"), model.w.shape[1])[0]).otherwise(predicted)
    return metrics.regression(rows.select("label", F.col("y")[0].alias("y"), predicted.alias("predicted")).where("predicted is not null"), "label")


def replicate_noise(spectra: DataFrame) -> DataFrame:
    """One row: pooled within-group deviation, root mean square over channels; null without replicates."""
    v = to_long(spectra.select("group_id", "x")).groupBy("group_id", "j").agg(F.count("*").alias("n"), F.var_samp("v").alias("s")).where("n > 1")
    per = v.groupBy("j").agg((F.sum((F.col("n") - 1) * F.col("s")) / F.sum(F.col("n") - 1)).alias("pooled"))
    return per.agg(F.sqrt(F.avg("pooled")).alias("noise"))


def processed_replicates(spectra: DataFrame, train: DataFrame, steps: tuple[str, ...], window: int = 25) -> DataFrame:
    """The rows of groups with two rows or more, transformed by what the training rows teach; nothing is learned
    from the replicates. Feed it to replicate_noise for the noise that a model on processed spectra sees."""
    from prismlake.operators.preprocess import fit_apply

    several = spectra.where("group_id is not null and x is not null").groupBy("group_id").agg(F.count("*").alias("_n")).where("_n > 1").select("group_id")
    return fit_apply(train, spectra.where("x is not null").join(several, "group_id", "left_semi"), steps, window)


def merit(spectra: DataFrame, coefficients: np.ndarray) -> dict[str, float | None]:
    """Sensitivity 1/|b|, detection 3.3 and quantification 10 times noise times |b|."""
    noise = replicate_noise(spectra).first()["noise"]
    norm = float(np.linalg.norm(coefficients))
    if noise is None or norm == 0:
        return {"sensitivity": 1 / norm if norm else None, "noise": noise, "lod": None, "loq": None}
    return {"sensitivity": 1 / norm, "noise": noise, "lod": 3.3 * noise * norm, "loq": 10 * noise * norm}


def known(spectra: DataFrame) -> DataFrame:
    """Rows of a known concentration."""
    return spectra.where("conc is not null and not isnan(conc)")


def is_pure(conc: str = "conc") -> Column:
    """No concentration, or zero."""
    c = F.col(conc)
    return c.isNull() | F.isnan(c) | (c == 0)


def quantifiable(spectra: DataFrame, least: int = 6, spread: float = 1e-8) -> DataFrame:
    """label, n, quantifiable: classes with `least` adulterated rows and some spread of concentration."""
    g = known(spectra).groupBy("label").agg(F.count_if(F.col("conc") > 0).alias("n"), F.stddev_pop("conc").alias("sd"))
    return g.select("label", "n", ((F.col("n") >= least) & (F.col("sd") >= spread)).alias("quantifiable"))


def outside_range(value: Column, low: float | None, high: float | None) -> Column:
    """Whether a prediction lies outside the declared working range; False where none is declared."""
    return F.lit(False) if low is None or high is None else ~value.between(low, high)


def class_seen(predicted: DataFrame | None, spectra: DataFrame, mode: str = "blind") -> DataFrame:
    """spectra with `seen`, the class that a calibration may see, and `mode`. blind: the class predicted for
    the row; control: its own; without predictions blind can't be, and the mode says forced-control."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if mode == "control" or predicted is None:
        return spectra.withColumn("seen", F.col("label")).withColumn("mode", F.lit("control" if mode == "control" else "forced-control"))
    return spectra.join(predicted.select("sample_id", F.col("predicted").alias("seen")), "sample_id").withColumn("mode", F.lit("blind"))


def _sum(parts: list[Moments]) -> Moments:
    return sum(parts[1:], parts[0])


def _best_lv(parts: list[Moments], p: int, most: int) -> tuple[int, float]:
    """(components, rmsecv): the fewest of the least cross-validated error."""
    total = _sum(parts)
    press = np.zeros(most)
    for m in parts:
        model = fit_pls(total - m, p, most)
        for a in range(most):
            press[a] += error_sum(model, min(a + 1, model.w.shape[1]), m, p).sum()
    a = int(np.argmin(np.round(press, 12)))
    return a + 1, float(np.sqrt(press[a] / total.n))


def calibrate_by_part(parted: DataFrame, keys: tuple[str, ...] = (), most: int = 8, folds: int = 5, least_cal: int = 4, least_val: int = 2, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(summary, rows): a calibration per key on the rows of part `calibration`, judged on those of part
    `validation`. The number of components is chosen by folds of groups within the calibration part only.

    summary: keys, n_cal, n_val, components, rmsec, rmsecv, and of the validation rows rmse (RMSEP), r2, bias,
    sep, rpd, rer, dmody_limit. rows: the validation rows with predicted and dmody. Keys with fewer rows than
    the least are left out. All models come from one pass over moments; predictions are one scan."""
    from prismlake.operators.splits import hashed_folds

    spark = parted.sparkSession
    p = channels(parted)
    rows = hashed_folds(known(parted), folds).withColumn("y", F.array("conc")).withColumn("key", F.to_json(F.struct(*keys)) if keys else F.lit("{}"))
    by = moments(rows.withColumn("cell", F.concat_ws("\x01", "key", "part", F.col("fold").cast("string"))), "cell")
    cal: dict[str, list[Moments]] = {}
    n_val: dict[str, float] = {}
    for cell, m in by.items():
        key, part, _ = cell.split("\x01")
        if part == "calibration":
            cal.setdefault(key, []).append(m)
        else:
            n_val[key] = n_val.get(key, 0) + m.n
    predicted, facts = F.lit(None).cast("double"), []
    for key, parts in cal.items():
        total = _sum(parts)
        if total.n < least_cal or n_val.get(key, 0) < least_val:
            continue
        top = max(1, min(most, max(2, int(total.n) // 5), p, int(total.n) - 1))
        a, rmsecv = _best_lv(parts, p, top) if len(parts) > 1 else (1, float("nan"))
        model = fit_pls(total, p, a)
        a = model.w.shape[1]
        if not a:
            continue
        facts.append((key, int(total.n), a, float(np.sqrt(error_sum(model, a, total, p).sum() / total.n)), rmsecv, diagnostics.dmody_limit(spark, a, int(n_val[key]), alpha)))
        predicted = F.when(F.col("key") == key, model.predict(F.col("x"), a)[0]).otherwise(predicted)
    table = spark.createDataFrame(facts, "key string, n_cal int, components int, rmsec double, rmsecv double, dmody_limit double")
    held = rows.where("part = 'validation'").withColumn("predicted", predicted).where("predicted is not null").withColumn("y", F.col("y")[0])
    held = held.join(table.select("key", "components"), "key")
    e = F.col("predicted") - F.col("y")
    scale = held.groupBy("key").agg(F.sqrt(F.sum(e * e) / F.greatest(F.count("*") - F.first("components") - 1, F.lit(1))).alias("_s"))
    out = held.join(scale, "key").withColumn("dmody", F.abs(e) / F.when(F.col("_s") > 1e-12, F.col("_s")).otherwise(1.0))
    summary = metrics.regression(held, "key").withColumnRenamed("n", "n_val").join(table, "key")
    named = [F.get_json_object("key", f"$.{k}").alias(k) for k in keys]
    return summary.select(*named, "n_cal", "n_val", "components", "rmsec", "rmsecv", "rmse", "r2", "bias", "sep", "rpd", "rer", "dmody_limit"), out.select("sample_id", *keys, "y", "predicted", "dmody")


def r2_by_class_and_adulterant(spectra: DataFrame, folds: int = 5, most: int = 8, levels: int = 3, groups: int = 3, limit: float = 0.70) -> DataFrame:
    """label, adulterant, n, r2, status: cross-validated r2 of the concentration for each class and each
    adulterant, the pure rows of the class standing as zero in each. status: ok from the limit on, weak under
    it, n/a where there are no adulterated rows, too few levels or groups, or no spread.

    The adulterant is the letter in the group key. Pure rows are repeated once for each adulterant of the
    few there are, before the moments are taken by (class, adulterant, fold)."""
    from prismlake.operators.splits import hashed_folds

    spark = spectra.sparkSession
    p = channels(spectra)
    rows = known(spectra).withColumn("adulterant", titles.adulterant_of(F.col("group_id")))
    kinds = rows.where("conc > 0 and adulterant is not null").select("adulterant").distinct()
    pure = rows.where("conc <= 0").drop("adulterant").crossJoin(F.broadcast(kinds))
    used = hashed_folds(rows.where("conc > 0 and adulterant is not null").unionByName(pure), folds)
    facts = used.groupBy("label", "adulterant").agg(F.count("*").alias("n"), F.count_if(F.col("conc") > 0).alias("n_adulterated"), F.countDistinct("conc").alias("levels"), F.countDistinct("group_id").alias("groups"), F.stddev_pop("conc").alias("sd"))
    by = moments(used.withColumn("y", F.array("conc")).withColumn("cell", F.concat_ws("\x01", "label", "adulterant", F.col("fold").cast("string"))), "cell")
    parts: dict[tuple[str, str], list[Moments]] = {}
    for cell, m in by.items():
        label, kind, _ = cell.split("\x01")
        parts.setdefault((label, kind), []).append(m)
    out = []
    for r in facts.collect():
        r2 = None
        own = parts[(r["label"], r["adulterant"])]
        if r["n_adulterated"] and r["levels"] >= levels and r["groups"] >= groups and r["sd"] >= 1e-8 and len(own) > 1:
            total = _sum(own)
            a = max(1, min(most, int(total.n) // 5, r["levels"] - 1))
            press = 0.0
            for m in own:
                model = fit_pls(total - m, p, a)
                press += error_sum(model, model.w.shape[1], m, p).sum()
            r2 = float(1 - press / np.trace(total.centred()[1][p:, p:]))
        out.append((r["label"], r["adulterant"], r["n"], r2, "n/a" if r2 is None else "ok" if r2 >= limit else "weak"))
    every = spectra.select("label").distinct().crossJoin(F.broadcast(kinds))
    table = spark.createDataFrame(out, "label string, adulterant string, n long, r2 double, status string")
    return every.join(table, ["label", "adulterant"], "left").select("label", "adulterant", F.coalesce("n", F.lit(0)).alias("n"), "r2", F.coalesce("status", F.lit("n/a")).alias("status"))


def figures_of_merit(spectra: DataFrame, coefficients: np.ndarray) -> dict[str, float | None]:
    """merit() with gamma = sensitivity / noise and the mean |cos| of the coefficients with centred spectra."""
    from prismlake.functions import rowlocal as R

    out = merit(spectra, coefficients)
    m = diagnostics.whole(spectra)
    centre = m.total[: len(coefficients)] / m.n
    c = F.zip_with("x", R.constants(centre), lambda a, b: a - b)
    norm = F.sqrt(R.dot(c, c)) * float(np.linalg.norm(coefficients))
    out["gamma"] = None if not out["noise"] or out["sensitivity"] is None else out["sensitivity"] / out["noise"]
    out["selectivity"] = spectra.select(F.avg(F.abs(F.when(norm > 0, R.dot(c, R.constants(coefficients)) / norm))).alias("v")).first()["v"]
    return out
