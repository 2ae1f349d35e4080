"""Sufficient statistics of wide data: n, sums and cross products of [x, y] by group, in one pass.

Each task adds its rows into one dense matrix per group and emits the rows of its upper triangle as
arrays; these are dealt by (group, row) and added as they stream in. Only half of (p + k) x (p + k) numbers
per group reach the driver, whatever the number of samples; folds, fits, error sums and subsets of channels
come from these alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Expand = Callable[[np.ndarray, np.ndarray], Iterable[tuple[str, np.ndarray, np.ndarray]]]


@dataclass
class Moments:
    n: float
    total: np.ndarray  # sums of [x, y]
    cross: np.ndarray  # cross products of [x, y]

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.n + o.n, self.total + o.total, self.cross + o.cross)

    def __sub__(self, o: Moments) -> Moments:
        return Moments(self.n - o.n, self.total - o.total, self.cross - o.cross)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """(means, centred cross products)."""
        m = self.total / max(self.n, 1)
        return m, self.cross - self.n * np.outer(m, m)

    def subset(self, keep: np.ndarray) -> Moments:
        return Moments(self.n, self.total[keep], self.cross[np.ix_(keep, keep)])


def channels(spectra: DataFrame, x: str = "x") -> int:
    """The channels of the first row that has any. A table without such a row can't be modelled: ValueError."""
    row = spectra.where(F.col(x).isNotNull()).select(F.size(x).alias("p")).first()
    if row is None:
        raise ValueError("no row with a spectrum")
    return row["p"]


def matrix(column: pa.ListArray, p: int | None = None) -> np.ndarray:
    """Arrays of one length as the rows of a matrix. Different lengths, or a missing value: ValueError."""
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size != (size[0] if p is None else p)).any():
        raise ValueError(f"spectra of different lengths: {sorted(set(size.tolist()) | ({p} if p is not None else set()))}")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a spectrum with a missing value")
    return flat.to_numpy().reshape(len(column), -1)


def moments(rows: DataFrame, group: str, x: str = "x", y: str = "y", expand: Expand | None = None) -> dict[str, Moments]:
    """Moments by the values of a string column (few of them: folds, classes). Rows without x or y, or of no
    group, don't count; no rows: no groups; rows of different lengths fail.

    expand(groups, matrix of x) may yield other sums: (name, the rows that count, their x)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            g = np.array(b.column(0).to_pylist(), object)
            spectra, targets = (matrix(b.column(i)) for i in (1, 2))
            for k, on, part in expand(g, spectra) if expand else ((k, g == k, spectra[g == k]) for k in sorted(set(g.tolist()))):
                z = np.hstack([np.ones((len(part), 1)), part, targets[on]])
                own = z.T @ z
                if k in sums and sums[k].shape != own.shape:
                    raise ValueError("spectra of different lengths")
                sums[k] = sums[k] + own if k in sums else own
        for k, m in sums.items():
            size = np.arange(len(m), 0, -1)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(m[np.triu_indices(len(m))]))
            yield pa.record_batch([pa.array([k] * len(m)), pa.array(np.arange(len(m)), pa.int32()), flat], ["g", "i", "row"])

    schema = "g string, i int, row array<double>"
    known = rows.select(F.col(group).cast("string").alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).where("g is not null and x is not null and y is not null")
    parts = known.mapInArrow(add, schema)
    summed = added(parts, ["g", "i"], schema).toArrow()
    rows_of: dict[str, dict[int, np.ndarray]] = {}
    values, ends = summed["row"].combine_chunks(), summed["row"].combine_chunks().offsets.to_numpy()
    flat = values.values.to_numpy()
    for n, (k, i) in enumerate(zip(summed["g"].to_pylist(), summed["i"].to_pylist(), strict=True)):
        rows_of.setdefault(k, {})[i] = flat[ends[n] : ends[n + 1]]
    out = {}
    for k in sorted(rows_of):
        m = np.zeros((len(rows_of[k]),) * 2)
        for i, r in rows_of[k].items():
            m[i, i:] = m[i:, i] = r
        out[k] = Moments(m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def added(parts: DataFrame, keys: list[str], schema: str, column: str = "row") -> DataFrame:
    """The arrays of equal keys added place by place. Rows are dealt by their keys and added as they come, so
    that a task holds one array for each of its keys."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            lists = b.column(b.schema.get_field_index(column))
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for n, key in enumerate(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys), strict=True)):
                part = flat[at[n] : at[n + 1]]
                if key in sums and len(sums[key]) != len(part):
                    raise ValueError("spectra of different lengths")
                sums[key] = sums[key] + part if key in sums else part.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], kinds[i]) for i in range(len(keys))), pa.array(list(sums.values()), pa.list_(pa.float64()))], [*keys, column])

    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[dict(parts.dtypes)[k]] for k in keys]
    return parts.select(*keys, column).repartition(*keys).mapInArrow(add, schema)


def one_hot(label: str, classes: list[str]):
    return F.array(*(F.when(F.col(label) == c, 1.0).otherwise(0.0) for c in classes))
