"""Metrics of predictions, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions.ordering import by_number


def nearest_centroid(spectra: DataFrame) -> DataFrame:
    """sample_id, label, predicted: the class whose mean spectrum is nearest (ties: lowest label). The
    class means go to tasks as literals: classes times channels numbers."""
    from prismlake.schema import to_long

    m = to_long(spectra.select("label", "x")).groupBy("label", "j").agg(F.avg("v").alias("m")).toPandas()
    means = {k: g.sort_values("j")["m"].tolist() for k, g in m.groupby("label")}
    distance = lambda c: F.aggregate(F.zip_with("x", F.lit(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    scored = F.array(*(F.struct(F.round(distance(c), 9).alias("d"), F.lit(k).alias("k")) for k, c in sorted(means.items())))
    return spectra.select("sample_id", "label", F.array_min(scored)["k"].alias("predicted"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def confusion_table(pairs: DataFrame) -> DataFrame:
    """label, predicted, n, share of the label's rows: all cells of the classes that occur, zero ones too."""
    classes = pairs.select(F.col("label").alias("c")).union(pairs.select("predicted")).where("c is not null").distinct()
    cells = classes.select(F.col("c").alias("label")).crossJoin(F.broadcast(classes.select(F.col("c").alias("predicted"))))
    n = cells.join(confusion(pairs), ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = pairs.groupBy("label").agg(F.count("*").alias("t"))
    return n.join(total, "label", "left").select("label", "predicted", "n", F.when(F.col("t") > 0, F.col("n") / F.col("t")).alias("share"))


def per_class(pairs: DataFrame) -> DataFrame:
    """label, support, recall, precision, f1, specificity; a ratio with nothing below its line is 0."""
    classes = pairs.select("label").union(pairs.select("predicted")).distinct()
    t = pairs.groupBy("label").agg(F.count("*").alias("support"), F.count_if(F.col("label") == F.col("predicted")).alias("tp"))
    p = pairs.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("named"))
    n = pairs.agg(F.count("*").alias("n"))
    j = classes.join(t, "label", "left").join(p, "label", "left").crossJoin(F.broadcast(n)).fillna(0, ["support", "tp", "named"])
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp = F.col("tp"), F.col("named") - F.col("tp")
    fn = F.col("support") - tp
    return j.select("label", "support", ratio(tp, F.col("support")).alias("recall"), ratio(tp, F.col("named")).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("n") - tp - fp - fn, F.col("n") - F.col("support")).alias("specificity"))


def summary(pairs: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy, macro precision, recall and f1, Cohen's kappa."""
    c = per_class(pairs)
    macro = c.agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count_if(F.col("support") > 0).alias("n_classes"))
    n = pairs.agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    a, b = pairs.groupBy("label").count(), pairs.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("m"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("count") * F.col("m")), F.lit(0)).alias("s"))
    j = macro.crossJoin(n).crossJoin(chance)
    pe = F.col("s") / (F.col("n") * F.col("n"))
    return j.select("accuracy", "balanced_accuracy", "precision", "recall", "f1", F.when(pe == 1, 0.0).otherwise((F.col("accuracy") - pe) / (1 - pe)).alias("kappa"), (F.col("n_classes") < 2).alias("degenerate"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """label, auc: one class against the rest, by mean ranks. scores: target, score, positive (boolean).

    Equal scores are counted together, and ranks are taken within buckets of the scores, whose counts give
    what lies below: no task orders all scores of a class."""
    ends = scores.agg(F.min("score"), F.max("score")).first()
    t = scores.groupBy("target", "score").agg(F.count("*").alias("n"), F.count_if("positive").alias("pos")).withColumn("_b", by_number(F.col("score"), ends[0] or 0.0, ends[1] or 0.0))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy("target", "_b").agg(F.sum("n").alias("_n"))
    sums = sums.select("target", "_b", F.coalesce(F.sum("_n").over(before(Window.partitionBy("target").orderBy("_b"))), F.lit(0)).alias("_below"))
    below = F.coalesce(F.sum("n").over(before(Window.partitionBy("target", "_b").orderBy("score"))), F.lit(0)) + F.col("_below")
    r = t.join(sums, ["target", "_b"]).withColumn("rank", below + (F.col("n") + 1) / 2)
    s = r.groupBy("target").agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    return s.select(F.col("target").alias("label"), F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def det_curve(scores: DataFrame) -> DataFrame:
    """label, score, miss, alarm at each threshold. Scores are summed within buckets of them first, and what
    goes before a bucket comes from the buckets' counts, so no task orders all scores of a class."""
    ends = scores.agg(F.min("score"), F.max("score")).first()
    t = scores.groupBy("target", "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    t = t.withColumn("_b", by_number(F.col("score"), ends[0] or 0.0, ends[1] or 0.0))
    sums = t.groupBy("target", "_b").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    above = Window.partitionBy("target").orderBy(F.desc("_b"))
    whole = Window.partitionBy("target")
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("target", "_b", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"{c}0") for c in "pq"), *(F.sum(f"_{c}").over(whole).alias(f"{c}1") for c in "pq"))
    own = Window.partitionBy("target", "_b").orderBy(F.desc("score"))
    r = t.join(sums, ["target", "_b"]).select("target", "score", *((F.sum(c).over(own) + F.col(f"{c}0")).alias(c) for c in "pq"), "p1", "q1").where("p1 > 0 and q1 > 0")
    return r.select(F.col("target").alias("label"), "score", (1 - F.col("p") / F.col("p1")).alias("miss"), (F.col("q") / F.col("q1")).alias("alarm"))


def det_at(curve: DataFrame, grid: list[float]) -> DataFrame:
    """label, alarm, miss: the least miss rate at no more than each false-alarm rate of the grid; 1 where none
    is that low."""
    g = curve.select("label").distinct().withColumn("at", F.explode(F.lit(grid)))
    j = g.join(curve.select("label", "alarm", "miss"), "label").groupBy("label", "at").agg(F.min(F.when(F.col("alarm") <= F.col("at"), F.col("miss"))).alias("miss"))
    return j.select("label", F.col("at").alias("alarm"), F.coalesce("miss", F.lit(1.0)).alias("miss"))


def det_eer(scores: DataFrame) -> DataFrame:
    """label, eer: at the threshold where miss and false-alarm rates differ least, their mean (of equal
    differences the highest threshold)."""
    best = F.min_by(F.struct("miss", "alarm"), F.struct(F.round(F.abs(F.col("miss") - F.col("alarm")), 12), -F.col("score")))
    return det_curve(scores).groupBy("label").agg(best.alias("b")).select("label", ((F.col("b.miss") + F.col("b.alarm")) / 2).alias("eer"))


def regression(pairs: DataFrame, *keys: str) -> DataFrame:
    """n, rmse, r2, bias, sep (ddof 1), rpd, rer of columns y and predicted; null where undefined."""
    e = F.col("predicted") - F.col("y")
    a = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0))).alias("r2"), F.avg(e).alias("bias"), F.stddev_samp(e).alias("sep"),
        F.stddev_samp("y").alias("sd"), (F.max("y") - F.min("y")).alias("span"),
    )
    low = F.when(F.col("sep") > 0, F.col("sep"))
    return a.select(*keys, "n", "rmse", "r2", "bias", "sep", (F.col("sd") / low).alias("rpd"), (F.col("span") / low).alias("rer"))


def rpd_band(rpd):
    """Five bands of predictive value; not estimable without a finite value."""
    return F.when(rpd.isNull() | F.isnan(rpd), "not estimable").when(rpd < 2.0, "unsuitable").when(rpd < 2.5, "screening").when(rpd < 3.0, "fair").when(rpd < 5.0, "good").otherwise("excellent")


def hotelling(scores: DataFrame, columns: list[str]) -> DataFrame:
    """T2 = sum of squared scores over their variances (ddof 1; a variance of 0 counts as 1)."""
    v = scores.agg(*(F.var_samp(c).alias(f"_{c}") for c in columns))
    parts = [F.col(c) ** 2 / F.when(F.col(f"_{c}") == 0, 1.0).otherwise(F.col(f"_{c}")) for c in columns]
    return scores.crossJoin(F.broadcast(v)).withColumn("t2", sum(parts[1:], parts[0])).drop(*(f"_{c}" for c in columns))


def moments_dof(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """mean and degrees of freedom 2 (mean / sd)^2 by moments (ddof 1); degenerate: 1."""
    m, s = F.avg(column), F.stddev_samp(column)
    return values.groupBy(*keys).agg(m.alias("mean"), F.coalesce(F.when((s > 0) & (m > 0), 2 * (m / s) ** 2), F.lit(1.0)).alias("dof"))
