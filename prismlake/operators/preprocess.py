"""Preprocessing of spectra: stateless rows, and transforms whose state is learned on training rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions import rowlocal as R
from prismlake.schema import to_long

PRESETS = {
    "mc": ("center",), "autoscaling": ("autoscale",), "snv": ("snv",), "snv_mc": ("snv", "center"), "msc_mc": ("msc", "center"), "sg_mc": ("savgol", "center"),
    "snv_sg_mc": ("snv", "savgol", "center"), "msc_sg_mc": ("msc", "savgol", "center"),
}


def preset(name: str, snv: bool = False, msc: bool = False, savgol: bool = False, center: bool = False, autoscale: bool = False) -> tuple[str, ...]:
    """The steps of a preset. Any other name is custom: the flagged steps in this order, centring if none."""
    flags = {"snv": snv, "msc": msc, "savgol": savgol, "center": center, "autoscale": autoscale}
    return PRESETS.get(name) or tuple(k for k, v in flags.items() if v) or ("center",)


def column_moments(spectra: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population deviation) of every channel: one aggregation, two rows of p numbers back."""
    m = to_long(spectra.select("x")).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).toPandas().sort_values("j")
    return m["m"].to_numpy(), m["s"].to_numpy()


def truncate(spectra: DataFrame, wn: np.ndarray, lo: float, hi: float) -> tuple[DataFrame, np.ndarray]:
    keep = np.flatnonzero((wn >= lo) & (wn <= hi))
    if not len(keep):
        raise ValueError(f"no channel lies in [{lo}, {hi}]")
    index = F.lit([int(k) for k in keep])
    return spectra.withColumn("x", F.transform(index, lambda i: F.get("x", i))), wn[keep]


def interpolate(spectra: DataFrame, wn: np.ndarray, grid: np.ndarray) -> DataFrame:
    """Linear interpolation of every row to another axis, ends clamped: two taps for each grid point."""
    order = np.argsort(wn)
    at = np.clip(np.searchsorted(wn[order], grid), 1, len(wn) - 1)
    left, right = order[at - 1], order[at]
    share = np.clip((grid - wn[left]) / (wn[right] - wn[left]), 0, 1)
    return spectra.withColumn("x", R.two_taps(F.col("x"), left, right, share))


def fit_apply(train: DataFrame, other: DataFrame, steps: tuple[str, ...], window: int = 7) -> DataFrame:
    """Learns the state of the steps on train and applies them to other. A row shorter than the window of a
    derivative has a null x after it; without training rows, or with null x, so has every row of a learned step."""
    for step in steps:
        if step == "snv":
            f = lambda d: d.withColumn("x", R.snv(F.col("x")))
        elif step == "l2":
            f = lambda d: d.withColumn("x", R.l2_normalize(F.col("x")))
        elif step == "savgol":
            f = lambda d: d.withColumn("x", R.savgol(F.col("x"), window))
        elif step in ("center", "autoscale", "msc"):
            m, s = column_moments(train)
            if step == "msc":
                f = lambda d, m=m: d.withColumn("x", R.msc(F.col("x"), R.constants(m)))
            else:
                f = lambda d, m=m, s=s if step == "autoscale" else np.ones(len(m)): d.withColumn("x", R.affine(F.col("x"), R.constants(m), R.constants(s)))
        else:
            raise ValueError(f"unknown step {step!r}; known: snv, l2, savgol, center, autoscale, msc")
        train, other = f(train), f(other)
    return other


def moving_average(long: DataFrame, half: int, key: str = "sample_id") -> DataFrame:
    """Centred mean over 2 * half + 1 channels, zero-padded; edge values take the nearest full window's."""
    w = Window.partitionBy(key).orderBy("j").rowsBetween(-half, half)
    whole = Window.partitionBy(key)
    s = long.withColumn("m", F.sum("v").over(w) / (2 * half + 1)).withColumn("last", F.max("j").over(whole))
    first = F.max(F.when(F.col("j") == half, F.col("m"))).over(whole)
    end = F.max(F.when(F.col("j") == F.col("last") - half, F.col("m"))).over(whole)
    return s.select(key, "j", "v", F.when(F.col("j") < half, first).when(F.col("j") > F.col("last") - half, end).otherwise(F.col("m")).alias("smooth"))


def snr_by_channel(long: DataFrame, half: int = 3) -> DataFrame:
    """j, snr, useful: deviation of the smoothed signal over that of the residual, per channel, with the
    noise floored at a thousandth of its median. Useful at 3 or more."""
    s = moving_average(long, half).groupBy("j").agg(F.stddev_samp("smooth").alias("signal"), F.stddev_samp(F.col("v") - F.col("smooth")).alias("noise"))
    floor = s.agg((F.percentile("noise", 0.5) * 1e-3).alias("floor"))
    snr = F.col("signal") / F.greatest("noise", "floor")
    return s.crossJoin(F.broadcast(floor)).select("j", snr.alias("snr"), (snr >= 3).alias("useful"))


def regions(mask: DataFrame, flag: str) -> DataFrame:
    """Runs of consecutive channels of which the flag is true: first, last, channels. One row per channel
    goes in, so the ordered window is over the axis, never over samples."""
    w = Window.orderBy("j")
    run = F.sum(F.when(F.col(flag) != F.coalesce(F.lag(flag).over(w), ~F.col(flag)), 1).otherwise(0)).over(w)
    return mask.withColumn("run", run).where(flag).groupBy("run").agg(F.min("j").alias("first"), F.max("j").alias("last"), F.count("*").alias("channels")).drop("run")


def diagnose_axis(spectra: DataFrame, wn: np.ndarray, half: int = 3, least_snr: float = 3.0, least_width: float = 150.0) -> tuple[DataFrame, DataFrame]:
    """(regions, summary). regions: first, last (axis values, ascending), kind: runs of channels under the
    least ratio of signal to noise, as wide as least_width; dead where the median of the signal's deviation is
    under a tenth of its greatest, else noisy. summary: useful share, and from and to of the useful channels
    where less than 0.95 are useful."""
    spark = spectra.sparkSession
    p = len(wn)
    long = to_long(spectra.select("sample_id", "x"))
    s = moving_average(long, half).groupBy("j").agg(F.stddev_samp("smooth").alias("signal"), F.stddev_samp(F.col("v") - F.col("smooth")).alias("noise")).toPandas().sort_values("j")
    signal, noise = s["signal"].to_numpy(float), s["noise"].to_numpy(float)
    floor = float(np.median(noise[noise > 0])) if (noise > 0).any() else 1.0
    snr = signal / np.maximum(noise, floor * 1e-3)
    snr[:half], snr[p - half :] = snr[half], snr[p - half - 1]
    useful = snr >= least_snr
    size = signal / max(float(signal.max()), 1e-12)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (~useful).astype(np.int8), [0]])))
    rows = []
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if abs(wn[b - 1] - wn[a]) >= least_width:
            rows.append((float(min(wn[a], wn[b - 1])), float(max(wn[a], wn[b - 1])), "dead" if np.median(size[a:b]) < 0.10 else "noisy"))
    share = float(useful.mean())
    suggested = (float(wn[useful].min()), float(wn[useful].max())) if useful.any() and share < 0.95 else (None, None)
    return spark.createDataFrame(rows, "first double, last double, kind string"), spark.createDataFrame([(share, *suggested)], "useful double, suggested_from double, suggested_to double")


def validation_report(spectra: DataFrame) -> DataFrame:
    """check, n: rows with a value that is no number, constant channels, exact copies, near-duplicate pairs."""
    from prismlake.operators import quality

    finite = quality.drop_nonfinite(spectra)
    rows = [spectra.agg((F.count("*") - F.count_if(R.finite(F.col("x")))).alias("n")).select(F.lit("nonfinite_rows").alias("check"), "n"),
            quality.constant_columns(finite).agg(F.count_if("constant").alias("n")).select(F.lit("constant_channels").alias("check"), "n"),
            quality.exact_duplicates(finite).select(F.lit("exact_copies").alias("check"), F.col("n_copies").cast("long").alias("n")),
            quality.near_duplicates(finite).agg(F.count("*").alias("n")).select(F.lit("near_duplicate_pairs").alias("check"), "n")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])
