"""One call for the tables of an analysis: what is asked for and can be had, each built from shared parts.

A result belongs to an objective (exploratory, classification, quantification) and says what it needs; nothing is
computed for a result that isn't built, and what several need (folds, states of the preprocessing, moments, the
component curve, predictions) is computed once. Every result of the objective has a note: made, or why not."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.config import Settings
from prismlake.functions import rowlocal as R
from prismlake.operators import benchmark, diagnostics, latent, metrics, oneclass, pipeline, preprocess, quality, quantify, splits, validation
from prismlake.operators.gram import Moments
from prismlake.schema import to_long

EXPLORATORY, CLASSIFICATION, QUANTIFICATION = "exploratory", "classification", "quantification"


class Parts:
    """What results share; each part is computed when it is first asked for."""

    def __init__(self, spectra: DataFrame, settings: Settings, wn: np.ndarray | None = None):
        self.settings, self.spark = settings, spectra.sparkSession
        kept = quality.drop_nonfinite(spectra.where("x is not null"))
        self.wn = wn
        if wn is not None and (settings.wn_min is not None or settings.wn_max is not None):
            kept, self.wn = preprocess.truncate(kept, wn, -np.inf if settings.wn_min is None else settings.wn_min, np.inf if settings.wn_max is None else settings.wn_max)
        self.spectra = kept

    @cached_property
    def facts(self) -> dict:
        """Rows, classes, groups, and distinct known concentrations, in one pass."""
        r = self.spectra.agg(F.count("*").alias("rows"), F.countDistinct("label").alias("classes"), F.countDistinct("group_id").alias("groups"), F.countDistinct("conc").alias("levels"), F.max(F.size("x")).alias("channels"))
        return r.first().asDict()

    @cached_property
    def steps(self) -> pipeline.Steps:
        s = self.settings
        return pipeline.Steps(preprocess.preset(s.preset), s.window, s.poly, s.deriv)

    @cached_property
    def labelled(self) -> tuple[DataFrame, list[str]]:
        rows = self.spectra.where("label is not null")
        return latent.with_targets(splits.hashed_folds(rows, validation.effective_splits(rows, self.settings.folds), self.settings.seed))

    @cached_property
    def states(self) -> dict:
        return pipeline.learned_states(self.labelled[0], self.steps)

    @cached_property
    def folds(self) -> dict[str, pipeline.Fold]:
        return pipeline.fold_moments(self.labelled[0], self.steps, self.states)

    @cached_property
    def curve(self) -> list[tuple[int, float, float]]:
        return pipeline.curve(self.folds, len(self.labelled[1]), self.settings.most_components)

    @cached_property
    def components(self) -> int:
        return latent.choose_lv(self.curve)

    @cached_property
    def predicted(self) -> DataFrame:
        return pipeline.out_of_fold(*self.labelled, self.steps, self.components, self.states, self.folds)

    @cached_property
    def processed(self) -> DataFrame:
        """All rows under the state of all rows: for what describes the table and isn't judged by it."""
        return preprocess.fit_apply(self.spectra, self.spectra, self.steps.names, self.settings.window)

    @cached_property
    def channels(self) -> int:
        return self.facts["channels"]

    @cached_property
    def moments(self) -> Moments:
        rows, _ = latent.with_targets(self.processed.where("label is not null"), self.labelled[1])
        return diagnostics.whole(rows, F.col("y"))

    @cached_property
    def model(self) -> latent.Pls:
        return latent.fit_pls(self.moments, self.channels, self.components)

    @cached_property
    def pca(self) -> latent.Pca:
        return latent.fit_pca(diagnostics.whole(self.processed), self.channels, min(self.settings.most_components, 5))

    @cached_property
    def calibrated(self) -> tuple[DataFrame, tuple[DataFrame, int, np.ndarray]]:
        rows = splits.hashed_folds(self.processed, self.settings.folds, self.settings.seed)
        return rows, quantify.calibrate(rows)

    def axis(self, j: int) -> float:
        return float(j if self.wn is None else self.wn[j])


def _by_channel(parts: Parts, **columns: np.ndarray) -> DataFrame:
    rows = [(j, parts.axis(j), *(float(v[j]) for v in columns.values())) for j in range(parts.channels)]
    return parts.spark.createDataFrame(rows, "j int, wn double" + "".join(f", {c} double" for c in columns))


def _tree(p: Parts) -> DataFrame:
    means = to_long(p.processed.where("label is not null").select("label", p.pca.scores(F.col("x")).alias("x"))).groupBy("label", "j").agg(F.avg("v").alias("m")).toPandas()
    merges = latent.ward({k: g.sort_values("j")["m"].to_numpy() for k, g in means.groupby("label")})
    return p.spark.createDataFrame(merges, "left string, right string, height double")


def _loadings(p: Parts) -> DataFrame:
    rows = [(k, j, p.axis(j), float(v)) for k, column in enumerate(p.pca.loadings.T) for j, v in enumerate(column)]
    return p.spark.createDataFrame(rows, "component int, j int, wn double, loading double")


def _scores_by_class(p: Parts) -> DataFrame:
    """target, score, positive: each class's share against the others."""
    classes = p.labelled[1]
    each = p.predicted.select("label", F.posexplode(R.clip_normalize(F.col("scores"))).alias("k", "score"))
    target = F.get(F.lit(classes), F.col("k"))
    return each.select(target.alias("target"), "score", (F.col("label") == target).alias("positive"))


@dataclass(frozen=True)
class Result:
    objective: str
    what: str
    build: Callable[[Parts], DataFrame]
    classes: int = 0  # classes, groups and levels of concentration that it needs at least
    groups: int = 0
    levels: int = 0
    costly: bool = False  # made only when asked for by name

    def lacking(self, facts: dict) -> str | None:
        for need, n in (("classes", self.classes), ("groups", self.groups), ("levels", self.levels)):
            if facts[need] < n:
                return f"needs {n} {'levels of concentration' if need == 'levels' else need}; there are {facts[need]}"
        return None


RESULTS = {
    "mean_spectra": Result(EXPLORATORY, "mean and deviation of each class by channel", lambda p: to_long(p.spectra.select("label", "x")).groupBy("label", "j").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n")), classes=1),
    "pca_scores": Result(EXPLORATORY, "scores of the principal components", lambda p: p.processed.select("sample_id", "label", F.posexplode(p.pca.scores(F.col("x"))).alias("component", "score"))),
    "pca_loadings": Result(EXPLORATORY, "loadings of the principal components", _loadings),
    "class_tree": Result(EXPLORATORY, "Ward merges of the class centroids", _tree, classes=2),
    "component_curve": Result(CLASSIFICATION, "error and Q2 by number of components", lambda p: p.spark.createDataFrame(p.curve, "components int, rmsecv double, q2 double"), classes=2, groups=2),
    "predictions": Result(CLASSIFICATION, "out-of-fold predictions", lambda p: p.predicted, classes=2, groups=2),
    "confusion": Result(CLASSIFICATION, "confusion table of the predictions", lambda p: metrics.confusion_table(p.predicted), classes=2, groups=2),
    "summary": Result(CLASSIFICATION, "accuracy and company of the predictions", lambda p: metrics.summary(p.predicted), classes=2, groups=2),
    "roc": Result(CLASSIFICATION, "area under the curve of each class", lambda p: metrics.roc_auc(_scores_by_class(p)), classes=2, groups=2),
    "vip_and_sr": Result(CLASSIFICATION, "importance of channels", lambda p: _by_channel(p, vip=latent.vip(p.model, p.model.w.shape[1]), sr=latent.selectivity_ratio(p.model, p.model.w.shape[1], p.moments, p.channels)), classes=2, groups=2),
    "one_class": Result(CLASSIFICATION, "sensitivity of one-class models by groups left out", lambda p: oneclass.leave_group_out(p.processed), classes=1, groups=2, costly=True),
    "comparison": Result(CLASSIFICATION, "preprocessings under the same folds", lambda p: validation.compare_preprocessings(p.spectra, p.settings.most_components, p.settings.folds, p.settings.window), classes=2, groups=2, costly=True),
    "permutations": Result(CLASSIFICATION, "test against permuted labels", lambda p: validation.permutation_test(p.processed, p.labelled[1], p.components, p.settings.folds, seed=p.settings.seed), classes=2, groups=4, costly=True),
    "monte_carlo": Result(CLASSIFICATION, "random splits of groups", lambda p: validation.monte_carlo(p.processed, p.components, seed=p.settings.seed), classes=2, groups=4, costly=True),
    "benchmark": Result(CLASSIFICATION, "other classifiers under the same folds", lambda p: benchmark.classifiers(p.spectra, p.components, steps=p.steps), classes=2, groups=3, costly=True),
    "calibration": Result(QUANTIFICATION, "out-of-fold figures of the regression", lambda p: metrics.regression(p.calibrated[1][0]), groups=2, levels=2),
    "figures_of_merit": Result(QUANTIFICATION, "sensitivity, noise and limits of the regression", lambda p: p.spark.createDataFrame([(k, None if v is None else float(v)) for k, v in quantify.figures_of_merit(p.calibrated[0], p.calibrated[1][2]).items()], "figure string, value double"), groups=2, levels=2),
}


def tables(spectra: DataFrame, settings: Settings | None = None, objective: str = CLASSIFICATION, wanted: list[str] | None = None, wn: np.ndarray | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by name, notes). Without `wanted`, the results of the objective that aren't costly; with it, those
    named, of any objective. notes: result, objective, made, note, a row for every result of the objective and
    every one named. A result that fails is a note, not the end of the run; an unknown name is an error."""
    if objective not in (EXPLORATORY, CLASSIFICATION, QUANTIFICATION):
        raise ValueError(f"unknown objective {objective!r}; known: {EXPLORATORY}, {CLASSIFICATION}, {QUANTIFICATION}")
    if unknown := [n for n in wanted or [] if n not in RESULTS]:
        raise ValueError(f"unknown results {unknown}; known: {', '.join(RESULTS)}")
    parts = Parts(spectra, settings or Settings(), wn)
    made: dict[str, DataFrame] = {}
    notes = []
    for name, r in RESULTS.items():
        asked = name in wanted if wanted is not None else r.objective == objective
        if not asked and r.objective != objective:
            continue
        if not asked:
            note = "not asked for"
        elif wanted is None and r.costly:
            note = "costly: ask for it by name"
        elif not parts.facts["rows"]:
            note = "no rows"
        else:
            note = r.lacking(parts.facts)
        if note is None:
            try:
                made[name] = r.build(parts)
            except (ValueError, np.linalg.LinAlgError) as e:
                note = str(e).splitlines()[0][:200]
        notes.append((name, r.objective, name in made, note or r.what))
    return made, parts.spark.createDataFrame(notes, "result string, objective string, made boolean, note string")
