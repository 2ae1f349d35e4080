"""Convex hulls of point clouds by class: each task keeps the hull of its points, and hulls are merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chain(points: np.ndarray) -> np.ndarray:
    """Vertices counter-clockwise from the lowest (x, y), by a monotone chain; points on an edge are none. One or
    two distinct points, or points of one line, are their own ends."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(order: Iterator[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for c in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]):
                out.pop()
            out.append(c)
        return out

    return np.array(half(iter(points))[:-1] + half(iter(points[::-1]))[:-1])


#: Points that a task holds of a class before it takes their hull.
HELD = 50_000


def convex_hull(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, step, x, y: the vertices of each class, counter-clockwise from the lowest x (then y).

    The hull of hulls is the hull of all, so a task sends the vertices of its own points, and these are merged
    again by class and part before one task takes the last. Points with a null, NaN or infinite coordinate don't
    count; a class without others has no rows."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for b in batches:
            keys = np.array(b.column(0).to_pylist(), object)
            xy = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1)
            for k in set(keys.tolist()):
                held.setdefault(k, []).append(xy[keys == k])
                if sum(map(len, held[k])) > HELD:
                    held[k] = [chain(np.concatenate(held[k]))]
        for k, parts in held.items():
            v = chain(np.concatenate(parts))
            yield pa.record_batch([pa.array([k] * len(v), pa.string()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v[:, 0]), pa.array(v[:, 1])], ["k", "step", "x", "y"])

    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    rows = points.select(F.col(key).cast("string").alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(finite[0] & finite[1] & F.col("k").isNotNull())
    schema = "k string, step int, x double, y double"
    once = rows.mapInArrow(local, schema)
    merged = once.repartition("k", F.pmod(F.xxhash64("x"), F.lit(64))).select("k", "x", "y").mapInArrow(local, schema)
    return merged.select("k", "x", "y").repartition("k").mapInArrow(local, schema).withColumnRenamed("k", key)
