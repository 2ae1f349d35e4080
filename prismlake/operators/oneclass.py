"""One-class models: a PCA per class, accepted or refused by a combined distance; conformal thresholds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismlake.functions import quantiles
from prismlake.operators.diagnostics import loo_q, mad_outliers, moments_dof
from prismlake.operators.gram import Moments, channels, moments
from prismlake.operators.latent import Pca, fit_pca


@dataclass
class ClassModel:
    label: str
    pca: Pca
    h0: float
    q0: float
    nh: float
    nq: float
    limit: float

    def distance(self, x: Column) -> Column:
        return self.pca.t2(x) / max(self.h0, 1e-12) * self.nh + self.pca.q(x) / max(self.q0, 1e-12) * self.nq


def _dof(mean: float | None, sd: float | None) -> float:
    return moments_dof(mean, sd)


def components_for(n: float, p: int, wanted: int) -> int:
    """The components of a class of n rows that leave two degrees of freedom to the residual."""
    return min(wanted, int(n) - 2, p - 1)


def fit(spectra: DataFrame, components: int = 5, alpha: float = 0.05) -> tuple[list[ClassModel], list[tuple[str, str]]]:
    """(models, refused classes with a reason). Fitted per class from one moments pass. T2 of the training rows
    and Q of each of them to the plane fitted without it, averaged over replicates of a group first, calibrate
    h0, q0 and their degrees of freedom."""
    spark = spectra.sparkSession
    p = channels(spectra)
    by_class = moments(spectra.withColumn("y", F.array(F.lit(0.0))), "label")
    pcas, refused = {}, []
    for k, m in sorted(by_class.items()):
        a = components_for(m.n, p, components)
        if a < 1:
            refused.append((k, "fewer than three rows"))
        else:
            pcas[k] = fit_pca(m, p, a)
    if not pcas:
        return [], refused
    t2 = F.coalesce(*(F.when(F.col("label") == k, m.t2(F.col("x"))) for k, m in pcas.items()))
    d = loo_q(spectra.where(F.col("label").isin(*pcas)).select("label", "group_id", "x"), "label", by_class, components).select("label", "group_id", t2.alias("t2"), F.col("q_loo").alias("q"))
    g = d.groupBy("label", "group_id").agg(F.avg("t2").alias("t2"), F.avg("q").alias("q"))
    c = g.groupBy("label").agg(F.avg("t2").alias("h0"), F.stddev_samp("t2").alias("hs"), F.avg("q").alias("q0"), F.stddev_samp("q").alias("qs")).collect()
    models = []
    for r in sorted(c, key=lambda r: r["label"]):
        nh, nq = _dof(r["h0"], r["hs"]), _dof(r["q0"], r["qs"])
        models.append(ClassModel(r["label"], pcas[r["label"]], r["h0"], r["q0"], nh, nq, quantiles.chi2(spark, 1 - alpha, nh + nq)))
    return models, refused


def training_flags(spectra: DataFrame, models: list[ClassModel]) -> DataFrame:
    """sample_id, label, t2, q, flagged: training rows that stand out of their class by median and MAD of T2
    or Q. They stay in the models."""
    pick = lambda f: F.coalesce(*(F.when(F.col("label") == m.label, f(m)) for m in models))
    d = spectra.where(F.col("label").isin(*(m.label for m in models))).select("sample_id", "label", pick(lambda m: m.pca.t2(F.col("x"))).alias("t2"), pick(lambda m: m.pca.q(F.col("x"))).alias("q"))
    return mad_outliers(d, ["t2", "q"], "label")


def boundary(model: ClassModel, points: int = 50) -> list[tuple[float, float]]:
    """The acceptance line in the axes T2 / h0 and Q / q0: where both parts of the distance sum to its limit."""
    x = np.linspace(0, model.limit / model.nh, points)
    return [(float(v), float(max(0.0, (model.limit - v * model.nh) / model.nq))) for v in x]


def specificity(scored: DataFrame, adulterated: Column) -> DataFrame:
    """model, specificity: the share of adulterated rows that a class model refuses."""
    return scored.where(adulterated).groupBy("model").agg(F.avg((~F.col("accepted")).cast("double")).alias("specificity"), F.count("*").alias("n"))


def score(spectra: DataFrame, models: list[ClassModel]) -> DataFrame:
    """sample_id, label, model, distance, accepted: each row against every class model, row-local."""
    each = F.array(*(F.struct(F.lit(m.label).alias("model"), m.distance(F.col("x")).alias("distance"), F.lit(m.limit).alias("limit")) for m in models))
    return spectra.select("sample_id", "label", F.inline(each)).withColumn("accepted", F.col("distance") <= F.col("limit"))


def decide(spectra: DataFrame, models: list[ClassModel]) -> DataFrame:
    """One class accepts: it. More: ambiguous. None: unknown."""
    ok = F.filter(F.array(*(F.when(m.distance(F.col("x")) <= m.limit, F.lit(m.label)) for m in models)), lambda v: v.isNotNull())
    return spectra.select("sample_id", "label", F.when(F.size(ok) == 1, ok[0]).when(F.size(ok) == 0, "unknown").otherwise("ambiguous").alias("decision"))


#: Rows and refits of a class that meet in one task of leave_group_out, and distances that it holds at once.
ROW_BLOCK, REFIT_BLOCK, AT_ONCE = 1 << 16, 1 << 12, 1 << 22


def leave_group_out(spectra: DataFrame, components: int = 5, alpha: float = 0.05) -> DataFrame:
    """label, sensitivity, n_groups, note: each group is judged by its class's model fitted without it.

    A group's refit is the class's moments minus its own, made where its few rows are. Rows and refits of a class
    are dealt into blocks, and every block of rows meets every block of refits in a task, which returns a row for
    each refit: counts, means and squared deviations over its groups, and the distance of the group that was left
    out. So no task and not the driver holds a class, and what is shuffled besides the blocks is linear."""
    spark = spectra.sparkSession
    p = channels(spectra)
    shared = spark.sparkContext.broadcast(moments(spectra.withColumn("y", F.array(F.lit(0.0))), "label"))

    def refit(key, frame):
        import pandas as pd

        label, out = key
        x = np.stack(frame["x"].to_numpy())
        z = np.hstack([x, np.zeros((len(x), 1))])
        m = shared.value[str(label)] - Moments(len(x), z.sum(0), z.T @ z)
        a = components_for(m.n, p, components)
        if a < 1:
            return pd.DataFrame({"label": [], "out": [], "mean": [], "loadings": [], "variance": []}, dtype=object)
        pca = fit_pca(m, p, a)
        return pd.DataFrame({"label": [label], "out": [out], "mean": [pca.mean], "loadings": [pca.loadings.T.ravel()], "variance": [pca.variance]})

    rows = spectra.where("label is not null and group_id is not null and x is not null").select("label", "group_id", "x")
    groups = spectra.groupBy("label").agg(F.countDistinct("group_id").alias("n_groups"))
    sizes = [(r["label"], -(-r["n"] // ROW_BLOCK), -(-r["g"] // REFIT_BLOCK)) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("g")).collect()]
    sizes = F.broadcast(spark.createDataFrame(sizes, "label string, row_blocks long, refit_blocks long"))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    refits = rows.groupBy("label", "group_id").applyInPandas(refit, "label string, out string, mean array<double>, loadings array<double>, variance array<double>")
    refits = refits.join(sizes, "label").select("label", block("out", "refit_blocks").alias("c"), every("row_blocks").alias("b"), "out", "mean", "loadings", "variance")
    dealt = rows.join(sizes, "label").select("label", block("group_id", "row_blocks").alias("b"), every("refit_blocks").alias("c"), "group_id", "x")

    def meet(own, models):
        import pandas as pd

        names = ["label", "out", "n", "mt", "st", "mq", "sq", "t2", "q"]
        if not len(own) or not len(models):
            return pd.DataFrame({k: [] for k in names}, dtype=object)
        own = own.sort_values("group_id", kind="stable")
        group = own["group_id"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.diff(np.append(first, len(group)))[:, None]
        place = {g: i for i, g in enumerate(group[first])}
        x = np.stack(own["x"].to_numpy())
        centre = x.mean(0)
        x = x - centre
        norm = (x * x).sum(1)[:, None]
        parts = []
        at_once = max(1, AT_ONCE // len(x))
        # refits of one number of components together
        for a, some in models.groupby(models["variance"].map(len)):
            for at in range(0, len(some), at_once):
                part = some.iloc[at : at + at_once]
                mean = np.stack(part["mean"].to_numpy()) - centre
                loadings = np.stack(part["loadings"].to_numpy()).reshape(len(part), a, p)
                variance = np.stack(part["variance"].to_numpy())
                q = norm - 2 * (x @ mean.T) + (mean * mean).sum(1)
                t2 = np.zeros_like(q)
                for k in range(a):
                    t = x @ loadings[:, k].T
                    t -= (mean * loadings[:, k]).sum(1)
                    t *= t
                    q -= t
                    t2 += t / np.where(variance[:, k] > 1e-24, variance[:, k], 1.0)
                np.maximum(q, 0, out=q)
                t2, q = (np.add.reduceat(v, first, axis=0) / count for v in (t2, q))
                seat = np.array([place.get(o, -1) for o in part["out"]])
                here, j = seat >= 0, np.arange(len(part))
                n = len(first) - here
                table = {"label": part["label"].to_numpy(), "out": part["out"].to_numpy(), "n": n}
                for v, m, s, name in ((t2, "mt", "st", "t2"), (q, "mq", "sq", "q")):
                    mine = np.where(here, v[seat, j], np.nan)
                    others = v.sum(0) - np.where(here, mine, 0)
                    table[m] = others / np.maximum(n, 1)
                    table[s] = np.maximum(((v - table[m]) ** 2).sum(0) - np.where(here, (mine - table[m]) ** 2, 0), 0)
                    table[name] = pd.array(mine, "Float64")
                parts.append(pd.DataFrame(table))
        return pd.concat(parts)[names]

    met = dealt.groupBy("label", "b", "c").cogroup(refits.groupBy("label", "b", "c")).applyInPandas(meet, "label string, out string, n long, mt double, st double, mq double, sq double, t2 double, q double")
    n, known = F.sum("n"), []
    for m, s, mean, sd in (("mt", "st", "h0", "hs"), ("mq", "sq", "q0", "qs")):
        at = F.sum(F.col("n") * F.col(m)) / n
        spread = F.sum(s) + F.sum(F.col("n") * F.col(m) * F.col(m)) - n * at * at
        known += [at.alias(mean), F.when(n > 1, F.sqrt(F.greatest(F.when(F.count("*") > 1, spread).otherwise(F.sum(s)), F.lit(0.0)) / (n - 1))).alias(sd)]
    by_group = met.groupBy("label", "out").agg(*known, F.max("t2").alias("t2"), F.max("q").alias("q"), n.alias("n")).where("n > 0")
    dof = lambda m, s: F.coalesce(F.when((F.col(m) > 0) & (F.col(s) > 0), 2 * (F.col(m) / F.col(s)) ** 2), F.lit(1.0))
    by_group = by_group.withColumn("nh", dof("h0", "hs")).withColumn("nq", dof("q0", "qs"))
    f = F.col("t2") / F.greatest("h0", F.lit(1e-12)) * F.col("nh") + F.col("q") / F.greatest("q0", F.lit(1e-12)) * F.col("nq")
    inside = quantiles.chi2_below(f, F.col("nh") + F.col("nq")) <= 1 - alpha
    s = by_group.groupBy("label").agg(F.avg(inside.cast("double")).alias("sensitivity"), F.count("*").alias("judged"))
    j = groups.join(s, "label", "left")
    valid = (F.col("n_groups") >= 2) & (F.coalesce("judged", F.lit(0)) >= 2)
    return j.select("label", F.when(valid, F.col("sensitivity")).alias("sensitivity"), "n_groups", F.when(~valid, "not validated").when(F.col("n_groups") < 10, "few groups").alias("note"))


def procrustes_set(spectra: DataFrame, components: int = 5) -> DataFrame:
    """label, group_id, x: pseudo-validation rows, one for each row of a class that can be fitted.

    A segment (a group; a row, where the class has one group only) is projected on its class's plane fitted
    without it; the plane's loadings are rotated onto the class's own by the closest rotation, which puts the
    scores there; the residual takes the row's direction outside of the plane and the length that it had for the
    other one. So scores and distances are those of rows the model has not seen (Procrustes cross-validation,
    Kucheryavskiy et al. 2020). The refit of a segment is its class's moments minus its own, made where its rows
    are; class moments, p x p numbers each, go to the tasks, and no task holds a class."""
    by_class = moments(spectra.withColumn("y", F.array(F.lit(0.0))), "label")
    known = {}
    for k, m in by_class.items():
        p = len(m.total) - 1
        a = min(components, int(m.n) - 2, p)
        if a >= 1:
            known[k] = (m, fit_pca(m, p, a))
    groups = spectra.groupBy("label").agg(F.countDistinct("group_id").alias("_groups"))
    rows = spectra.where(F.col("label").isin(*known) & F.col("x").isNotNull()).join(groups, "label")
    rows = rows.select("label", "group_id", F.when(F.col("_groups") > 1, F.concat(F.lit("g"), "group_id")).otherwise(F.concat(F.lit("r"), F.col("sample_id").cast("string"))).alias("segment"), "x")
    shared = spectra.sparkSession.sparkContext.broadcast(known)

    def turn(key, frame):
        import pandas as pd

        m, pca = shared.value[str(key[0])]
        x = np.stack(frame["x"].to_numpy())
        z = np.hstack([x, np.zeros((len(x), 1))])
        left = m - Moments(len(x), z.sum(0), z.T @ z)
        p, a = x.shape[1], pca.loadings.shape[1]
        if left.n - 1 < a:
            return pd.DataFrame({"label": [], "group_id": [], "x": []}, dtype=object)
        local = fit_pca(left, p, a)
        c = x - local.mean
        t = c @ local.loadings
        q = np.maximum((c * c).sum(1) - (t * t).sum(1), 0)
        u, _, v = np.linalg.svd(local.loadings.T @ pca.loadings)
        own = x - pca.mean
        e = own - own @ pca.loadings @ pca.loadings.T
        size = np.sqrt((e * e).sum(1))
        e = e * np.where(size > 1e-12, np.sqrt(q) / np.where(size > 1e-12, size, 1), 0)[:, None]
        return pd.DataFrame({"label": frame["label"], "group_id": frame["group_id"], "x": list(pca.mean + t @ (u @ v) @ pca.loadings.T + e)})

    return rows.groupBy("label", "segment").applyInPandas(turn, "label string, group_id string, x array<double>")


def procrustes_sensitivity(spectra: DataFrame, components: int = 5, alpha: float = 0.05) -> DataFrame:
    """label, sensitivity, n_groups, n_rows, note: the share of pseudo-validation rows that the class's model
    accepts. It stands beside leave_group_out, not in its place: of one group it shows measurement noise only. A
    class that can't be fitted has no sensitivity."""
    models, _ = fit(spectra, components, alpha)
    groups = spectra.groupBy("label").agg(F.countDistinct("group_id").alias("n_groups"), F.count("*").alias("n_rows"))
    note = F.when(F.col("sensitivity").isNull(), "not validated").when(F.col("n_groups") < 2, "one group: measurement noise only").otherwise("exploratory")
    if not models:
        return groups.withColumn("sensitivity", F.lit(None).cast("double")).select("label", "sensitivity", "n_groups", "n_rows", note.alias("note"))
    accepted = F.coalesce(*(F.when(F.col("label") == m.label, m.distance(F.col("x")) <= m.limit) for m in models))
    s = procrustes_set(spectra, components).select("label", accepted.alias("ok")).groupBy("label").agg(F.avg(F.col("ok").cast("double")).alias("sensitivity"))
    return groups.join(s, "label", "left").select("label", "sensitivity", "n_groups", "n_rows", note.alias("note"))


def conformal_accepts(rows: DataFrame, thresholds: DataFrame, score: str, *keys: str) -> DataFrame:
    """rows with `accepted`: the score is within the threshold of its keys; never where there is none."""
    t = thresholds.select(*keys, "threshold")
    joined = rows.join(t, list(keys), "left") if keys else rows.crossJoin(F.broadcast(t))
    return joined.withColumn("accepted", F.coalesce(F.col(score) <= F.col("threshold"), F.lit(False)))


def conformal_threshold(scores: DataFrame, alpha: float = 0.05, group: str = "group_id", score: str = "score", *keys: str) -> DataFrame:
    """keys, n, k, threshold: replicates count once (their median); the k-th smallest of n with
    k = ceil((n + 1)(1 - alpha)), or null where n is too small for that alpha."""
    g = scores.groupBy(*keys, group).agg(F.percentile(score, 0.5).alias("s"))
    n = g.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("k", F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 9)).cast("int"))
    w = Window.partitionBy(*keys).orderBy("s", group) if keys else Window.orderBy("s", group)
    r = g.withColumn("rank", F.row_number().over(w))
    j = n.join(r, list(keys), "left") if keys else n.crossJoin(r)
    return j.groupBy(*keys, "n", "k").agg(F.max(F.when(F.col("rank") == F.col("k"), F.col("s"))).alias("threshold"))


def reachable_alpha(n: int) -> float:
    return 1 / (n + 1)


def needed_for_alpha(alpha: float) -> int:
    return int(np.ceil(round((1 - alpha) / alpha, 9)))


def hotelling_limit(spark: SparkSession, n: int, k: int, alpha: float = 0.05) -> float:
    return quantiles.hotelling_limit(spark, n, k, alpha)
