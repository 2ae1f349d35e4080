"""Significance and stability of a classification, with data that stay spread: permutations over physical
samples, Wold lines, bias-corrected bootstrap, Monte-Carlo splits, comparison of preprocessings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from prismlake.functions import quantiles
from prismlake.functions.ordering import by_hash, numbered
from prismlake.functions.tables import stored
from prismlake.operators import pipeline, splits
from prismlake.operators.gram import Moments, added, channels, moments
from prismlake.operators.latent import Pls, error_sum, fit_pls, vip, with_targets


def effective_splits(spectra: DataFrame, wanted: int) -> int:
    """The folds that can be had: no more than wanted, than rows of the least class or than its groups; two
    at least."""
    r = spectra.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("g")).agg(F.min("n").alias("n"), F.min("g").alias("g")).first()
    return max(2, min(wanted, r["n"] or 2, r["g"] or 2))


def stratified_folds(spectra: DataFrame, folds: int, seed: int = 42, repeat: int = 0) -> DataFrame:
    """Folds without groups: rows of a class are dealt in the order of a seeded hash. Another repeat deals anew."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(repeat)), F.col("sample_id").cast("string")))
    ranked = numbered(spectra.withColumn("_h", h), by_hash(F.col("_h")), "_h", "sample_id", keys=("label",))
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("_h", "rank")


def majority_class(spectra: DataFrame) -> DataFrame:
    """group_id, label: the commonest class of a group, the lowest of equally common ones."""
    n = spectra.groupBy("group_id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("group_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))


def _digest(seed: int, number: Column) -> Column:
    """The hash of a group in a round, by which groups are ordered; groups of one hash by name."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), number.cast("string"), "group_id"))


def bounds(groups: DataFrame, wanted: DataFrame, rounds: list[int], seed: int, *keys: str) -> list[Row]:
    """keys, round, place, h, group_id: the group that stands at a place (from 1) in a round's order of the keys.

    groups: keys, group_id. wanted: keys, place, a few rows. Groups are counted in 4096 buckets of the hash; only
    those in a bucket that holds a wanted place are put in order. So a round costs a count, not a sort."""
    every = groups.withColumn("round", F.explode(F.lit(rounds))).withColumn("_h", _digest(seed, F.col("round")))
    placed = every.withColumn("_b", by_hash(F.col("_h")))
    counts = placed.groupBy(*keys, "round", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys, "round").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = counts.withColumn("_to", F.sum("_n").over(before))
    held = held.join(F.broadcast(wanted), list(keys)) if keys else held.crossJoin(F.broadcast(wanted))
    # the places of a bucket, counted from its first
    held = held.where("place <= _to and place > _to - _n").groupBy(*keys, "round", "_b").agg(F.collect_list(F.struct("place", (F.col("place") - F.col("_to") + F.col("_n")).alias("own"))).alias("_places"))
    own = F.row_number().over(Window.partitionBy(*keys, "round", "_b").orderBy("_h", "group_id"))
    met = placed.join(F.broadcast(held), [*keys, "round", "_b"]).withColumn("_own", own)
    return met.select(*keys, "round", F.col("_h").alias("h"), "group_id", "_own", F.inline("_places")).where("own = _own").select(*keys, "round", "place", "h", "group_id").collect()


def test_rounds(spectra: DataFrame, rounds: int, share: float = 0.2, seed: int = 42) -> DataFrame:
    """group_id, label, rounds: the rounds (ascending) that a group is tested in, which are those in which it is
    among the first ceil(share) of its class's groups in the order of a hash of the round."""
    g = majority_class(spectra)
    wanted = g.groupBy("label").agg(F.ceil(F.count("*") * share).alias("place")).where("label is not null and place > 0")
    ends: dict[str, list] = {}
    for r in bounds(g, wanted, list(range(rounds)), seed, "label"):
        ends.setdefault(r["label"], [("", "")] * rounds)[r["round"]] = (r["h"], r["group_id"])
    table = spectra.sparkSession.createDataFrame(list(ends.items()), "label string, _ends array<struct<h string, g string>>")
    each = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.struct(r.alias("round"), F.struct(_digest(seed, r).alias("h"), F.col("group_id").alias("g")).alias("at")))
    within = F.filter(each, lambda e: e["at"] <= F.get("_ends", e["round"]))
    return g.join(F.broadcast(table), "label").select("group_id", "label", F.transform(within, lambda e: e["round"]).alias("rounds"))


def shuffle_splits(spectra: DataFrame, rounds: int, share: float = 0.2, seed: int = 42) -> DataFrame:
    """round, group_id, label: groups to test on, a ceil(share) of each class's groups in the order of a hash
    of the round."""
    return test_rounds(spectra, rounds, share, seed).select(F.explode("rounds").alias("round"), "group_id", "label")


def permuted_labels(spectra: DataFrame, classes: list[str], rounds: int, seed: int = 42) -> DataFrame:
    """group_id, labels: class numbers of a group by round; round 0 is its own. In each round the groups,
    in the order of a hash, take the classes in turn as often as there are groups of them: a permutation
    of the labels over physical samples. The groups where a class ends are found first; then a group's label is
    the number of those that come before it, by its own hash alone."""
    own = majority_class(spectra).select("group_id", (F.array_position(F.lit(classes), F.col("label")) - 1).cast("int").alias("own"))
    counts = {r["own"]: r["n"] for r in own.groupBy("own").agg(F.count("*").alias("n")).collect()}
    ends = np.cumsum([counts.get(k, 0) for k in range(len(classes))]).tolist()
    wanted = spectra.sparkSession.createDataFrame([(int(e),) for e in sorted(set(ends)) if e], "place long")
    last: dict[tuple[int, int], tuple[str, str]] = {(r["round"], r["place"]): (r["h"], r["group_id"]) for r in bounds(own.select("group_id"), wanted, list(range(1, rounds + 1)), seed)} if rounds and ends[-1] else {}
    # a class without groups before the first one ends before every group
    table = F.lit(json.dumps([[dict(zip("hg", last[r, e] if e else ("", ""), strict=True)) for e in ends] for r in range(1, rounds + 1)]))
    table = F.from_json(table, "array<array<struct<h string, g string>>>")
    each = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.struct(r.alias("round"), F.struct(_digest(seed, r).alias("h"), F.col("group_id").alias("g")).alias("at")))
    label = lambda e: F.size(F.filter(F.get(table, e["round"] - 1), lambda end: end < e["at"]))
    return own.select("group_id", F.concat(F.array("own"), F.transform(each, label) if rounds else F.array().cast("array<int>")).alias("labels"))


class Permutations:
    """Fold statistics of all rounds of permuted labels. The products of x don't depend on labels and are
    taken once for each fold; of x with the labels, a sum for each round, fold and class."""

    def __init__(self, spectra: DataFrame, classes: list[str], folds: int, rounds: int, seed: int):
        self.classes, self.folds, self.rounds = classes, folds, rounds
        self.p = p = channels(spectra)
        folded = splits.hashed_folds(spectra, folds, seed)
        # read by each of the passes
        self.rows = folded.join(stored(permuted_labels(spectra, classes, rounds, seed)), "group_id").select("fold", "x", "labels")
        by = moments(self.rows.withColumn("y", F.array(F.lit(0.0))), "fold")
        self.x = {int(k): m.subset(np.arange(p)) for k, m in by.items()}
        kinds = len(classes)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for b in batches:
                if not b.num_rows:
                    continue
                fold = b.column(0).to_numpy()
                x = np.hstack([np.ones((b.num_rows, 1)), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)])
                labels = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                sums = np.zeros((labels.shape[1], folds, kinds, x.shape[1])) if sums is None else sums
                for r in range(labels.shape[1]):
                    np.add.at(sums[r], (fold, labels[:, r]), x)
            if sums is not None:
                r, f, k = (v.ravel() for v in np.indices(sums.shape[:3]))
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(f, pa.int32()), pa.array(k, pa.int32()), pa.array(list(sums.reshape(-1, sums.shape[3])), pa.list_(pa.float64()))], ["r", "f", "k", "row"])

        schema = "r int, f int, k int, row array<double>"
        got = added(self.rows.mapInArrow(add, schema), ["r", "f", "k"], schema).toArrow()
        self.sums = np.zeros((rounds + 1, folds, kinds, p + 1))
        self.sums[got["r"].to_numpy(), got["f"].to_numpy(), got["k"].to_numpy()] = np.array(got["row"].to_pylist())

    def moments(self, r: int, f: int) -> Moments:
        x, s = self.x[f], self.sums[r, f]
        n, xy = s[:, 0], s[:, 1:].T
        return Moments(x.n, np.concatenate([x.total, n]), np.block([[x.cross, xy], [xy.T, np.diag(n)]]))

    def models(self, r: int, components: int) -> Iterator[tuple[int, Moments, Moments, Pls]]:
        parts = {f: self.moments(r, f) for f in self.x}
        total = sum(list(parts.values())[1:], next(iter(parts.values())))
        for f, m in parts.items():
            yield f, total, m, fit_pls(total - m, self.p, components)

    def q2_and_r2(self, r: int, components: int) -> tuple[float, float]:
        press = 0.0
        total = None
        for _, total, m, model in self.models(r, components):
            press += error_sum(model, model.w.shape[1], m, self.p).sum()
        ss = np.trace(total.centred()[1][self.p :, self.p :])
        model = fit_pls(total, self.p, components)
        clip = lambda v: float(max(-1.0, 1 - v / ss))
        return clip(press), clip(error_sum(model, model.w.shape[1], total, self.p).sum())

    def balanced_accuracy(self, components: int) -> np.ndarray:
        """Out-of-fold balanced accuracy of each round: the fold models of all rounds go to the tasks, counts
        come back."""
        kinds, p = len(self.classes), self.p
        b = np.zeros((self.rounds + 1, self.folds, p + 1, kinds))
        for r in range(self.rounds + 1):
            for f, _, _, model in self.models(r, components):
                c = model.coefficients(model.w.shape[1])
                b[r, f] = np.vstack([model.y_mean - model.x_mean @ c, c])
        shared = self.rows.sparkSession.sparkContext.broadcast(b)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits = np.zeros((len(shared.value), kinds, 2), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                fold = batch.column(0).to_numpy()
                x = np.hstack([np.ones((batch.num_rows, 1)), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)])
                labels = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                for f in np.unique(fold):
                    on = fold == f
                    for r in range(labels.shape[1]):
                        right = (x[on] @ shared.value[r, f]).argmax(1) == labels[on, r]
                        np.add.at(hits[r], labels[on, r], np.stack([right, np.ones(len(right), bool)], 1).astype(np.int64))
            r, k = (v.ravel() for v in np.indices(hits.shape[:2]))
            yield pa.record_batch([pa.array(r), pa.array(k), pa.array(hits[:, :, 0].ravel()), pa.array(hits[:, :, 1].ravel())], ["r", "k", "hit", "n"])

        got = self.rows.mapInArrow(count, "r long, k long, hit long, n long").groupBy("r", "k").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).where("n > 0")
        table = got.groupBy("r").agg(F.avg(F.col("hit") / F.col("n")).alias("v")).toPandas()
        return table.sort_values("r")["v"].to_numpy()

    def similarity(self) -> np.ndarray:
        """Share of rows whose label of a round is their own."""
        same = F.transform("labels", lambda k: (k == F.get("labels", F.lit(0))).cast("int"))
        got = self.rows.select(F.posexplode(same).alias("r", "v")).groupBy("r").agg(F.avg("v").alias("v")).toPandas()
        return got.sort_values("r")["v"].to_numpy()


def permutation_test(spectra: DataFrame, classes: list[str], components: int, folds: int = 5, rounds: int = 100, seed: int = 42) -> DataFrame:
    """One row: observed balanced accuracy, n_valid, p_value = (rounds at least as good + 1) / (rounds + 1)."""
    v = Permutations(spectra, classes, folds, rounds, seed).balanced_accuracy(components)
    return spectra.sparkSession.createDataFrame([(float(v[0]), len(v) - 1, float((np.count_nonzero(v[1:] >= v[0] - 1e-12) + 1) / len(v)))], "observed double, n_valid int, p_value double")


def wold_test(spectra: DataFrame, classes: list[str], components: int, folds: int = 5, rounds: int = 100, seed: int = 42) -> DataFrame:
    """round (0: the labels as they are), similarity, r2, q2; rows for the two lines."""
    p = Permutations(spectra, classes, folds, rounds, seed)
    same = p.similarity()
    rows = []
    for r in range(rounds + 1):
        q2, r2 = p.q2_and_r2(r, components)
        rows.append((r, float(same[r]), r2, q2))
    return spectra.sparkSession.createDataFrame(rows, "round int, similarity double, r2 double, q2 double")


def wold_lines(points: DataFrame) -> DataFrame:
    """One row: intercepts and slopes of r2 and q2 on similarity; valid under 0.40 and 0.05. Null for points of
    one similarity."""
    some = F.max("similarity") - F.min("similarity") > 1e-8
    line = points.agg(*(F.when(some, f(y, "similarity")).alias(f"{n}_{y}") for y in ("r2", "q2") for n, f in (("intercept", F.regr_intercept), ("slope", F.regr_slope))))
    return line.withColumn("valid_r2", F.coalesce(F.col("intercept_r2") < 0.40, F.lit(False))).withColumn("valid_q2", F.coalesce(F.col("intercept_q2") < 0.05, F.lit(False)))


def balanced_accuracy(counts: np.ndarray) -> float:
    """Mean recall of a confusion table over the classes that have rows."""
    n = counts.sum(1)
    return float((np.diag(counts)[n > 0] / n[n > 0]).mean()) if (n > 0).any() else float("nan")


def confusion(pairs: DataFrame, classes: list[str]) -> np.ndarray:
    """Counts by (label, predicted) as a matrix, in the order of the classes."""
    table = np.zeros((len(classes),) * 2, np.int64)
    for r in pairs.where(F.col("label").isin(classes) & F.col("predicted").isin(classes)).groupBy("label", "predicted").agg(F.count("*").alias("n")).collect():
        table[classes.index(r["label"]), classes.index(r["predicted"])] = r["n"]
    return table


def bca_interval(pairs: DataFrame, metric: Callable[[np.ndarray], float] = balanced_accuracy, rounds: int = 500, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """low, high, observed: the bias-corrected and accelerated bootstrap interval of a metric of the
    confusion table, stratified by class.

    A row counts through its cell only: drawing n_k rows of a class anew is drawing its cells from a
    multinomial of their counts, and leaving out a row is taking one from its cell. So the table of counts
    is all that is needed, whatever the number of rows. Under 20 rounds there is no interval; if all rounds
    lie on one side, it is the percentile interval."""
    spark = pairs.sparkSession
    cells = pairs.groupBy("label", "predicted").agg(F.count("*").alias("n")).toPandas()
    names = sorted(set(cells["label"]) | set(cells["predicted"]))
    table = np.zeros((len(names),) * 2, np.int64)
    table[[names.index(v) for v in cells["label"]], [names.index(v) for v in cells["predicted"]]] = cells["n"]
    observed = metric(table)
    rng = np.random.default_rng(seed)
    drawn = [np.stack([rng.multinomial(r.sum(), r / r.sum()) if r.sum() else r for r in table]) for _ in range(rounds)]
    boot = np.array([v for v in (metric(t) for t in drawn) if np.isfinite(v)])
    schema = "low double, high double, observed double, n_valid int"
    if len(boot) < 20:
        return spark.createDataFrame([(None, None, observed, len(boot))], schema)
    below = float((boot < observed).mean())
    lo, hi = alpha / 2, 1 - alpha / 2
    if 0 < below < 1:
        z0 = quantiles.normal(spark, below)
        n, left = [], []
        for i, j in zip(*np.nonzero(table), strict=True):
            one = table.copy()
            one[i, j] -= 1
            v = metric(one)
            n.append(table[i, j])
            left.append(v if np.isfinite(v) else observed)
        n, left = np.array(n, float), np.array(left)
        d = (n * left).sum() / n.sum() - left
        spread = 6 * (n * d**2).sum() ** 1.5
        a = (n * d**3).sum() / spread if spread > 0 else 0.0
        bounds = []
        for q in (lo, hi):
            z = z0 + quantiles.normal(spark, q)
            if 1 - a * z == 0:
                break
            bounds.append(quantiles.normal_cdf(spark, z0 + z / (1 - a * z)))
        if len(bounds) == 2:
            lo, hi = bounds
    return spark.createDataFrame([(float(np.quantile(boot, lo)), float(np.quantile(boot, hi)), observed, len(boot))], schema)


#: Bytes of the sums that a pass of bootstrap_vip adds up in a task.
SUM_BYTES = 64 << 20


#: Groups of a class whose weights a task adds in one table.
WEIGHT_BLOCK = 1024


def bootstrap_weights(spectra: DataFrame, rounds: int, seed: int = 7) -> DataFrame:
    """group_id, weights: how often a group is drawn in each round, when a class draws, with replacement, as many
    groups as it has. A draw is a seeded hash of (round, class, number of the draw) over the groups' numbers, which
    are taken in buckets: no task orders a class. Draws are dealt by the block of groups that they hit, as lists of
    numbers, and counted in a table for each block: no row is made for a draw."""
    g = majority_class(spectra).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "group_id")))
    ranked = stored(numbered(g, by_hash(F.col("_h")), "_h", "group_id", keys=("label",)).select("group_id", "label", "rank"))
    n = ranked.groupBy("label").agg(F.count("*").alias("n"))
    hit = lambda r: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), r.cast("string"), "label", F.col("rank").cast("string"))), 1, 15), 16, 10).cast("long") % F.col("n")
    draws = ranked.join(F.broadcast(n), "label").select("label", F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), hit).alias("hits"))
    size = WEIGHT_BLOCK

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            label = np.array(b.column(0).to_pylist(), object)
            hits = b.column(1).flatten().to_numpy().reshape(b.num_rows, rounds)
            for k in sorted(set(label.tolist())):
                at = hits[label == k]
                block = (at // size).ravel()
                cell = (at % size * rounds + np.arange(rounds)).ravel()
                order = np.argsort(block, kind="stable")
                block, cell = block[order], cell[order]
                first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                cells = pa.ListArray.from_arrays(pa.array(np.append(first, len(cell)), pa.int32()), pa.array(cell, pa.int32()))
                yield pa.record_batch([pa.array([k] * len(first), pa.string()), pa.array(block[first], pa.int64()), cells], ["label", "block", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            lists = b.column(2)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if key not in sums:
                    sums[key] = np.zeros(size * rounds, np.int32)
                np.add.at(sums[key], flat[ends[i] : ends[i + 1]], 1)
        for (k, block), table in sums.items():
            table = table.reshape(size, rounds)
            on = np.flatnonzero(table.any(1))
            weights = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1) * rounds, pa.int32()), pa.array(table[on].ravel()))
            yield pa.record_batch([pa.array([k] * len(on), pa.string()), pa.array(block * size + on + 1, pa.int64()), weights], ["label", "rank", "weights"])

    dealt = draws.mapInArrow(spread, "label string, block long, cells array<int>").repartition("label", "block")
    weights = dealt.mapInArrow(count, "label string, rank long, weights array<int>")
    return ranked.join(weights, ["label", "rank"]).select("group_id", "weights")


def bootstrap_vip(spectra: DataFrame, components: int, rounds: int = 100, seed: int = 7) -> DataFrame:
    """j, mean, sd, low, high, frequency (share of rounds at 1 or more) of VIP when the groups of each class are drawn
    anew. Groups that no round drew don't count; rounds without enough rows are left out.

    A pass adds the products of many rounds, as many as SUM_BYTES hold; the driver holds those of a pass."""
    rows, classes = with_targets(spectra)
    p = channels(spectra)
    weighted = rows.join(bootstrap_weights(spectra, rounds, seed), "group_id")
    a_pass = max(1, SUM_BYTES // (8 * (p + len(classes) + 1) ** 2))
    out = []
    for first in range(0, rounds, a_pass):
        n = min(a_pass, rounds - first)

        def drawn(g: np.ndarray, x: np.ndarray, n: int = n) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
            times = np.array([[int(v) for v in s.split(",")] for s in g.tolist()])
            for r in range(n):
                at = np.repeat(np.arange(len(x)), times[:, r])
                if len(at):
                    yield str(r), at, x[at]

        part = weighted.withColumn("_w", F.array_join(F.transform(F.slice("weights", first + 1, n), lambda v: v.cast("string")), ","))
        for m in moments(part, "_w", expand=drawn).values():
            if m.n > components + 1:
                model = fit_pls(m, p, components)
                out.append(vip(model, model.w.shape[1]))
    if not out:
        raise ValueError("no round has rows enough for the components")
    v = np.array(out)
    table = pd.DataFrame({"j": np.arange(p), "mean": v.mean(0), "sd": v.std(0), "low": np.quantile(v, 0.025, 0), "high": np.quantile(v, 0.975, 0), "frequency": (v >= 1).mean(0)})
    return spectra.sparkSession.createDataFrame(table)


#: Preprocessings that are compared.
VARIANTS = {
    "mc": ("center",), "autoscaling": ("autoscale",), "snv": ("snv", "center"), "msc": ("msc", "center"), "sg": ("savgol", "center"), "sg_snv": ("savgol", "snv", "center"), "snv_sg": ("snv", "savgol", "center"),
    "msc_sg": ("msc", "savgol", "center"),
}


def compare_preprocessings(spectra: DataFrame, most: int, folds: int = 5, window: int = 25) -> DataFrame:
    """preprocessing, components, rmsecv, q2, accuracy, balanced_accuracy: the best number of components of each
    of VARIANTS, by q2 (the fewest of equal ones), under the same folds of groups. Learned steps see the training
    folds only. A variant that can't be fitted has nulls and the reason in `note`."""
    folded, classes = with_targets(splits.hashed_folds(spectra, folds))
    rows = []
    for name, names in VARIANTS.items():
        steps = pipeline.Steps(names, window)
        try:
            states = pipeline.learned_states(folded, steps)
            parts = pipeline.fold_moments(folded, steps, states)
            a, rmsecv, q2 = max(pipeline.curve(parts, len(classes), most), key=lambda c: c[2])
            counts = confusion(pipeline.out_of_fold(folded, classes, steps, a, states, parts), classes)
            rows.append((name, a, rmsecv, max(-1.0, q2), float(np.trace(counts) / counts.sum()), balanced_accuracy(counts), None))
        except (ValueError, np.linalg.LinAlgError) as e:
            rows.append((name, None, None, None, None, None, str(e).splitlines()[0][:200]))
    return spectra.sparkSession.createDataFrame(rows, "preprocessing string, components int, rmsecv double, q2 double, accuracy double, balanced_accuracy double, note string")


def monte_carlo(spectra: DataFrame, components: int, rounds: int = 50, share: float = 0.2, seed: int = 42) -> DataFrame:
    """round, accuracy, balanced_accuracy, n_test over random splits of groups, stratified by class.

    A round's test rows are those of its groups. Training products are the total minus those of the test
    rows; a row carries the rounds that test it, whose sums its task adds, and whose models score it there:
    rows are not dealt once a round. Rounds whose test set lacks a class are left out; no rounds where fewer
    groups than classes are tested."""
    spark = spectra.sparkSession
    rows, classes = with_targets(spectra)
    p = channels(spectra)
    tests = test_rounds(spectra, rounds, share, seed).select("group_id", "rounds")
    held = rows.join(tests, "group_id").where("size(rounds) > 0").select("label", "x", "y", F.array_join(F.transform("rounds", lambda r: r.cast("string")), ",").alias("rounds"))
    empty = spark.createDataFrame([], "round int, accuracy double, balanced_accuracy double, n_test long")

    def tested(g: np.ndarray) -> np.ndarray:
        by = np.zeros((len(g), rounds), bool)
        for i, s in enumerate(g.tolist()):
            by[i, [int(v) for v in s.split(",")]] = True
        return by

    def of_round(g: np.ndarray, x: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        by = tested(g)
        for r in np.flatnonzero(by.any(0)):
            at = np.flatnonzero(by[:, r])
            yield str(r), at, x[at]

    by = moments(held, "rounds", expand=of_round)
    total = moments(rows.withColumn("all", F.lit("all")), "all")["all"]
    models = {int(r): fit_pls(total - m, p, components) for r, m in by.items() if (m.total[p:] > 0).all() and total.n - m.n > 2}
    if not models:
        return empty
    table = {r: np.vstack([m.y_mean - m.x_mean @ m.coefficients(m.w.shape[1]), m.coefficients(m.w.shape[1])]) for r, m in models.items()}
    shared = spark.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((rounds, len(classes), 2), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            by = tested(np.array(b.column(0).to_pylist(), object))
            label = np.array([classes.index(v) for v in b.column(1).to_pylist()])
            x = np.hstack([np.ones((b.num_rows, 1)), b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)])
            for r, model in shared.value.items():
                at = np.flatnonzero(by[:, r])
                np.add.at(n[r], label[at], np.stack([np.ones(len(at), np.int64), (x[at] @ model).argmax(1) == label[at]], 1))
        r, k = np.nonzero(n[:, :, 0])
        yield pa.record_batch([pa.array(r, pa.int32()), pa.array(k, pa.int32()), pa.array(n[r, k, 0]), pa.array(n[r, k, 1])], ["round", "label", "n", "hit"])

    known = held.where("label is not null and x is not null").select("rounds", "label", "x")
    per = known.mapInArrow(score, "round int, label int, n long, hit long").groupBy("round", "label").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    return per.groupBy("round").agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"), F.sum("n").alias("n_test"))


def interval_summary(rounds: DataFrame, value: str) -> DataFrame:
    """n, mean, median, sd (ddof 0) and the 95 % percentile interval of a value over rounds; nulls and NaN
    don't count."""
    v = rounds.where(F.col(value).isNotNull() & ~F.isnan(value))
    return v.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.stddev_pop(value).alias("sd"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))


def kennard_stone_split(points: DataFrame, share: float = 0.8) -> DataFrame:
    """points (group_id, x) with `part`: calibration for the ceil(share) of groups that farthest-first picks,
    validation for the others."""
    n = points.count()
    rest = splits.farthest_first_rest(points, max(1, int(np.ceil(share * n)))).withColumn("part", F.lit("validation"))
    known = F.col("group_id").isNotNull() & F.col("x").isNotNull()
    return points.join(rest, "group_id", "left").withColumn("part", F.when(known, F.coalesce("part", F.lit("calibration"))).otherwise("validation"))
