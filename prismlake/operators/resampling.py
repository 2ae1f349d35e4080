"""Resampling from fold moments and from row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions import quantiles
from prismlake.functions.ordering import by_number, numbered
from prismlake.operators.gram import moments
from prismlake.operators.latent import fit_pls


def cv_anova(spark: SparkSession, ss: float, press: float, n: int, components: int) -> dict[str, float | None]:
    """F test of the residuals of cross-validation against those around the mean, with A and n - A degrees
    of freedom: one effective output, as the columns of one-hot classes depend on each other. No spread, or
    no residual freedom: no F, p 1."""
    d1, d2 = components, n - components
    if ss > 0 and press >= ss:
        return {"f": 0.0, "p": 1.0, "df_model": d1, "df_residual": d2}
    if ss <= 0 or d2 <= 0:
        return {"f": None, "p": 1.0, "df_model": d1, "df_residual": d2}
    if press <= 0:
        return {"f": float("inf"), "p": 0.0, "df_model": d1, "df_residual": d2}
    f = ((ss - press) / d1) / (press / d2)
    return {"f": f, "p": quantiles.f_tail(spark, f, d1, d2), "df_model": d1, "df_residual": d2}


def martens(folded: DataFrame, p: int, components: int) -> pd.DataFrame:
    """Jackknife over fold models: channel, output, coefficient, se, t, p_value (null under three folds)."""
    by = moments(folded, "fold")
    total = sum(list(by.values())[1:], next(iter(by.values())))
    whole = fit_pls(total, p, components).coefficients(components)
    parts = np.stack([fit_pls(total - m, p, components).coefficients(components) for m in by.values()])
    m = len(parts)
    se = np.sqrt((m - 1) / m * ((parts - parts.mean(0)) ** 2).sum(0))
    spark = folded.sparkSession
    t = np.where(se > 0, whole / np.where(se > 0, se, 1), 0.0)
    pv = np.vectorize(lambda v: quantiles.t_two_sided(spark, v, m - 1))(np.round(t, 6)) if m >= 3 else np.full(t.shape, np.nan)
    j, k = np.indices(t.shape)
    return pd.DataFrame({"j": j.ravel(), "output": k.ravel(), "coefficient": whole.ravel(), "se": se.ravel(), "t": t.ravel(), "p_value": pv.ravel()})


def bootstrap_accuracy(pairs: DataFrame, rounds: int = 200, seed: int = 7) -> DataFrame:
    """n_boot, low, high: percentile interval of accuracy. Row i of round b is row hash(seed:b:i) mod n, a
    join on row numbers; counts are summed per round, so nothing but one number per round is gathered."""
    ends = pairs.agg(F.count("*").alias("n"), F.min("sample_id").alias("a"), F.max("sample_id").alias("b"))
    low, high = ends.select("a", "b").first()
    placed = numbered(pairs, by_number(F.col("sample_id"), low or 0, high or 0), "sample_id")
    numbers = placed.select((F.col("rank") - 1).alias("i"), (F.col("label") == F.col("predicted")).cast("int").alias("hit"))
    n = ends.select("n")
    pick = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("b"), F.lit(":"), F.col("i"))), 1, 8), 16, 10).cast("long") % F.col("n")
    draws = numbers.select("i").crossJoin(F.broadcast(n)).select("i", "n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("b")).select("b", pick.alias("i"))
    acc = draws.join(numbers, "i").groupBy("b").agg(F.avg("hit").alias("accuracy"))
    return acc.agg(F.count("*").alias("n_boot"), F.percentile("accuracy", 0.025).alias("low"), F.percentile("accuracy", 0.975).alias("high"))
