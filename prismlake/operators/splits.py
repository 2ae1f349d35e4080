"""Splits that keep replicates of one physical sample together, and a checker that proves it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions.ordering import by_hash, numbered
from prismlake.functions.tables import deleted, stored, written
from prismlake.operators.gram import matrix


def grouped_folds(spectra: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """group_id, fold: large groups first, each to the fold that then has the most even class counts.

    Groups with the same counts by class are alike, so the plan is made for kinds of groups: of n groups of a
    kind, n // folds go to each fold, which leaves the balance as it is, and the n % folds that are left go one
    after the other to the fold that suits them best. One row for each kind reaches the driver (kinds are pairs
    of class and size, mostly), and Spark deals the groups to the plan by their rank in the order of a hash.
    Rows without a group or label don't count; fewer groups than folds are an error."""
    counts = spectra.where("group_id is not null and label is not null").groupBy("group_id", "label").agg(F.count("*").alias("n"))
    groups = counts.groupBy("group_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("kind"))
    kinds = {r["kind"]: r["n"] for r in groups.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if folds > sum(kinds.values()):
        raise ValueError(f"{folds} folds need as many groups; there are {sum(kinds.values())}")
    parsed = {k: {e["label"]: e["n"] for e in json.loads(k)} for k in kinds}
    classes = sorted({c for e in parsed.values() for c in e})
    filled = np.zeros((folds, len(classes)))
    plan = []
    for kind in sorted(kinds, key=lambda k: (-sum(parsed[k].values()), k)):
        own = np.array([parsed[kind].get(c, 0) for c in classes], float)
        dealt = []
        for _ in range(kinds[kind] % folds):
            cost = [round(float((filled + own * (np.arange(folds) == f)[:, None]).std(axis=0).mean()), 12) for f in range(folds)]
            # of equally even folds, the emptiest
            best = min(range(folds), key=lambda f: (cost[f], filled[f].sum(), f))
            filled[best] += own
            dealt.append(best)
        filled += own * (kinds[kind] // folds)
        plan.append((kind, dealt))
    table = spectra.sparkSession.createDataFrame(plan, "kind string, dealt array<int>")
    ranked = numbered(groups.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "group_id"))), by_hash(F.col("_h")), "_h", "group_id", keys=("kind",))
    at = (F.col("rank") - 1).cast("int")
    fold = F.when(at < F.size("dealt"), F.get("dealt", at)).otherwise((at - F.size("dealt")) % folds)
    # folds are read again by every pass over the rows
    return stored(ranked.join(table, "kind").select("group_id", fold.cast("int").alias("fold")))


def hashed_folds(spectra: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """The same contract at any number of groups: a group's fold is a hash of its name. No shuffle."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id"))), 1, 8), 16, 10).cast("long")
    return spectra.withColumn("fold", (h % folds).cast("int"))


def leaks(folded: DataFrame) -> DataFrame:
    """Groups that stand in more than one fold."""
    return folded.groupBy("group_id").agg(F.min("fold").alias("first_fold"), F.max("fold").alias("last_fold"), F.count("*").alias("n")).where("first_fold <> last_fold")


def holdout_groups(spectra: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Groups to set aside: of those with any adulterated row (conc > 0), the first ceil(share * n) by hash."""
    g = spectra.groupBy("group_id").agg(F.max("conc").alias("top")).where("top > 0").select("group_id", F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id"))).alias("h"))
    n = g.agg(F.ceil(F.count("*") * share).cast("int").alias("n"))
    ranked = numbered(g, by_hash(F.col("h")), "h", "group_id")
    return ranked.crossJoin(F.broadcast(n)).where("rank <= n").select("group_id")


#: Points that a pass of kennard_stone brings to the driver, and distances that a task holds at once.
CANDIDATES, AT_ONCE = 4096, 1 << 21


def kennard_stone(points: DataFrame, k: int) -> list[str]:
    """The k groups chosen by farthest-first on group mean spectra, the first farthest from the centroid; of equally
    far ones (to 12 places) the first by name. Fewer points than k: all of them."""
    chosen: list[str] = []
    for names, _ in _farthest_first(points, k):
        chosen += names
    return chosen


def farthest_first_rest(points: DataFrame, k: int) -> DataFrame:
    """group_id of the points that kennard_stone leaves, without a list of those that it takes."""
    rest = points.where("group_id is not null and x is not null").select("group_id")
    for names, state in _farthest_first(points, k):
        rest = _without(state, names).select("group_id")
    return rest


def _farthest_first(points: DataFrame, k: int) -> Iterator[tuple[list[str], DataFrame]]:
    """Passes: (the groups chosen in it, the points that were left before it).

    points: group_id, x with a row per group. Every point carries its distance to the nearest chosen one. A pass
    takes the CANDIDATES farthest points: distances only shrink, so as long as the farthest of them is farther
    than all points outside, it is the next choice, and its distances to the other candidates are known. Then the
    chosen ones, in one step, lower the distances of all. A pass writes the points that are left, and those of the
    pass before go, so that no more than two passes are on disk."""
    if k < 1:
        return
    rows = points.where("group_id is not null and x is not null").select("group_id", "x")
    p = rows.select(F.size("x").alias("p")).first()
    if p is None:
        return
    means = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m")).collect()
    centre = np.zeros(p["p"])
    for r in means:
        centre[r["j"]] = r["m"]
    order = [F.desc(F.round("d", 12)), F.asc("group_id")]
    state = written(rows.withColumn("d", F.lit(float("inf"))))
    first = _nearer(state, [centre]).orderBy(*order).first()
    fresh = [(first["group_id"], np.array(first["x"]))]
    n = 1
    yield [first["group_id"]], state
    while n < k:
        before, state = state, written(_nearer(_without(state, [g for g, _ in fresh]), [x for _, x in fresh]))
        deleted(before)
        top = state.orderBy(*order).limit(CANDIDATES + 1).toArrow().combine_chunks()
        if not top.num_rows:
            break
        names, x = top["group_id"].to_pylist(), matrix(top["x"].combine_chunks())
        d = np.round(top["d"].to_numpy(), 12)
        # the last one stands for all points outside: none of them comes before it
        outside = (-d[-1], names[-1]) if len(names) > CANDIDATES else (np.inf, "")
        live = sorted(range(min(len(names), CANDIDATES)), key=names.__getitem__)
        names, x, d = [names[i] for i in live], x[live], d[live].copy()
        fresh = []
        while len(fresh) < len(names) and n < k:
            best = int(np.argmax(d))  # of equal ones, the first by name
            if fresh and (-d[best], names[best]) > outside:
                break
            n += 1
            fresh.append((names[best], x[best]))
            np.minimum(d, np.round(((x - x[best]) ** 2).sum(1), 12), out=d)
            d[best] = -np.inf
        yield [g for g, _ in fresh], state


def _without(state: DataFrame, names: list[str]) -> DataFrame:
    """state without the named groups; the names go to the tasks as one set."""
    shared = state.sparkSession.sparkContext.broadcast(pa.array(names, pa.string()))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.compute.invert(pa.compute.is_in(b.column(0), value_set=shared.value)))

    return state.mapInArrow(left, state.schema)


def _nearer(state: DataFrame, picked: list[np.ndarray]) -> DataFrame:
    """state (group_id, x, d) with d lowered to the least squared distance to the picked points.

    Products find, up to rounding, which points may be nearest; the distances to those are taken from differences,
    so that they are the same whatever is picked together."""
    shared = state.sparkSession.sparkContext.broadcast(np.array(picked))

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        size = (points * points).sum(1)
        for b in batches:
            if not b.num_rows:
                continue
            x, d = matrix(b.column(1)), b.column(2).to_numpy().copy()
            own = (x * x).sum(1)
            # far above the rounding of the products
            slack = 1e-11 * x.shape[1] * (own + size.max())
            step = max(1, AT_ONCE // len(points))
            for at in range(0, len(x), step):
                on = slice(at, at + step)
                near = x[on] @ points.T
                near *= -2
                near += own[on, None]
                near += size
                low = near.min(1)
                some = np.flatnonzero(low <= d[on] + slack[on])
                i, j = np.nonzero(near[some] <= np.minimum(low[some] + slack[on][some], d[on][some] + slack[on][some])[:, None])
                i = some[i] + at
                for part in range(0, len(i), AT_ONCE // 8):
                    a, c = i[part : part + AT_ONCE // 8], j[part : part + AT_ONCE // 8]
                    np.minimum.at(d, a, ((x[a] - points[c]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], ["group_id", "x", "d"])

    return state.mapInArrow(lower, "group_id string, x array<double>, d double")


def group_means(spectra: DataFrame) -> DataFrame:
    from prismlake.schema import to_array, to_long

    m = to_long(spectra.select("group_id", "x")).groupBy("group_id", "j").agg(F.avg("v").alias("v"))
    return to_array(m, "group_id")
