"""What a prediction owes to each channel: path-dependent Shapley values of Spark's tree ensembles, taken in
Arrow batches; linear models need the coefficient times the distance to the mean only.

A leaf is a product: of the features on its path, each known one must send the row its way (0 or 1), each unknown
one does so with the share of training rows that went there. The Shapley value of a feature in such a product
is a sum over the sizes of the known sets, whose weights are the coefficients of one polynomial. So leaves are
taken one after the other, and all rows of a batch, and all of a leaf's features, at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.operators.gram import matrix


@dataclass
class Leaf:
    """The features on the path to a leaf, with the bounds (low, high] that a row must keep and the share of the
    training rows that kept them; and what the leaf adds to each output."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def flatten(model) -> list[Leaf]:
    """The leaves of a fitted forest, of boosted trees or of one tree of Spark, weighted as the model weights them.

    Classification forests vote with their leaves' class shares, so outputs are probabilities (of equal trees);
    other trees have one output."""
    trees = list(model.trees) if hasattr(model, "trees") else [model]
    kinds = getattr(model, "numClasses", 0)
    if "GBT" in type(model).__name__:
        kinds, weights = 0, [float(w) for w in model.treeWeights]
    else:
        weights = [1.0 / len(trees)] * len(trees)
    out: list[Leaf] = []

    def walk(node, bounds: dict[int, tuple[float, float, float]], weight: float) -> None:
        if node.subtreeDepth() == 0:
            stats = np.array(list(node.impurityStats().stats()))
            value = stats / stats.sum() if kinds else np.array([node.prediction()])
            f = np.array(sorted(bounds), int)
            out.append(Leaf(f, *(np.array([bounds[k][i] for k in f.tolist()], float) for i in range(3)), weight * value))
            return
        split, n = node.split(), node.impurityStats().count()
        j, t = split.featureIndex(), split.threshold()
        low, high, share = bounds.get(j, (-np.inf, np.inf, 1.0))
        for child, lo, hi in ((node.leftChild(), low, min(high, t)), (node.rightChild(), max(low, t), high)):
            walk(child, {**bounds, j: (lo, hi, share * child.impurityStats().count() / n)}, weight)

    for tree, weight in zip(trees, weights, strict=True):
        walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"), {}, weight)
    return out


def shapley(leaves: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, values): base by output, values by row, channel and output. base plus the sum over the channels is
    the prediction."""
    outputs = len(leaves[0].value)
    base, phi = np.zeros(outputs), np.zeros((len(x), x.shape[1], outputs))
    for leaf in leaves:
        z, m = leaf.share, len(leaf.features)
        base += leaf.value * np.prod(z)
        if not m:
            continue
        xs = x[:, leaf.features]
        o = ((xs > leaf.low) & (xs <= leaf.high)).astype(float)
        weight = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
        for i in range(m):
            # coefficient s of the product of (z + o t) over the other features: known sets of s of them
            poly = np.zeros((len(x), m))
            poly[:, 0] = 1.0
            for j in (j for j in range(m) if j != i):
                shifted = np.zeros_like(poly)
                shifted[:, 1:] = poly[:, :-1] * o[:, j : j + 1]
                poly = poly * z[j] + shifted
            phi[:, leaf.features[i]] += ((o[:, i] - z[i]) * (poly @ weight))[:, None] * leaf.value
    return base, phi


def tree_attributions(rows: DataFrame, model, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """keys, output, base, shap (an array by channel): a row for each row with x and output of the model.

    The leaves, as many as the model has, go to the tasks; rows stay where they are."""
    leaves = flatten(model)
    shared = rows.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            base, phi = shapley(shared.value, matrix(b.column(len(keys))))
            n, outputs = len(phi), len(base)
            at = pa.array(np.repeat(np.arange(n), outputs))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keys))), pa.array(np.tile(np.arange(outputs, dtype=np.int32), n)), pa.array(np.tile(base, n)), pa.array(list(phi.transpose(0, 2, 1).reshape(n * outputs, -1)), pa.list_(pa.float64()))], [*keys, "output", "base", "shap"])

    kept = rows.where("x is not null").select(*keys, "x")
    schema = kept.select(*keys).withColumns({"output": F.lit(0), "base": F.lit(0.0), "shap": F.array(F.lit(0.0))}).schema
    return kept.mapInArrow(run, schema)


def importance(attributions: DataFrame) -> DataFrame:
    """output, j, importance: the mean size of a channel's attributions."""
    each = attributions.select("output", F.posexplode("shap").alias("j", "v"))
    return each.groupBy("output", "j").agg(F.avg(F.abs("v")).alias("importance"))
