"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are binned statistics of itself and of the lines before
and after it; forward-backward gives each line's probability of being good, and the mean of these,
weighted by line length, calibrated on the same sample, is the document's score. Lines of a labelled
document take its label for fitting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.textkernel import Texts, first_of_equal, mix, over_texts

#: Labelled documents for fitting, at most (by hash of doc_id): the bound of the driver's data.
SAMPLE_DOCUMENTS = 4000
#: ... and lines of each for fitting: with the documents, the bound of the driver's data.
SAMPLE_LINES = 500
GOOD_AT = 0.7
BINS = 8

_CLASS = {
    "symbol": np.isin(np.arange(256), list(b"#*$%&|<>@~^_=")), "upper": np.isin(np.arange(256), np.arange(65, 91)), "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "mark": np.isin(np.arange(256), list(b".,;:")), "bang": np.isin(np.arange(256), list(b"!?")), "bar": np.isin(np.arange(256), list(b"|/\\")),
}
STATISTICS = (*_CLASS, "words", "word_length", "repeats", "distinct", "seen", "document_words")
NEIGHBOURS = ("symbol", "upper", "bang", "bar", "repeats", "words")


def line_statistics(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x statistics, row of each line, bytes of each line)."""
    start, end, row = t.lines()
    size = np.maximum(end - start, 1)
    total = np.zeros(len(t.data) + 1, np.int64)
    columns = []
    for table in _CLASS.values():
        np.cumsum(table[t.data], out=total[1:])
        columns.append((total[end] - total[start]) / size)
    first, last = np.searchsorted(t.starts, start), np.searchsorted(t.starts, end)
    words = last - first
    per = np.maximum(words, 1)
    h = t.word_hash()
    line = np.repeat(np.arange(len(start)), words)
    same = np.zeros(len(h) + 1, np.int64)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    np.cumsum(again, out=same[1:])
    order, new = first_of_equal(mix(h + mix(line.astype(np.uint64))))
    distinct = np.bincount(line[order[new]], minlength=len(start))
    hashes = mix(t.span_hash(start, end) + mix(row.astype(np.uint64)))
    order, new = first_of_equal(hashes)
    seen = np.zeros(len(start))
    seen[order[~new]] = 1
    seen[words == 0] = 0
    columns += [np.log1p(words), size / per, (same[last] - same[first]) / per, distinct / per, seen, np.log1p(t.n_words[row])]
    return np.stack(columns, 1), row, end - start


@dataclass
class LineField:
    """cuts: bin borders of each statistic; weights: a log-odds per bin of a line and its neighbours;
    pair: log potentials of neighbouring labels; slope, offset: the calibration."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def active(self, stats: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Indexes into weights: own bins, then the bins of the line before and after (or `no line`)."""
        bins = np.stack([np.searchsorted(c, stats[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        d = len(self.cuts)
        own = bins + np.arange(d) * (BINS + 1)
        parts = [own]
        beside = [STATISTICS.index(s) for s in NEIGHBOURS]
        for side, shift in enumerate((1, -1)):
            there = np.zeros(len(row), bool)
            other = np.zeros((len(row), len(beside)), np.int64)
            if len(row) > 1:
                if shift == 1:
                    there[1:] = row[1:] == row[:-1]
                    other[1:] = bins[:-1, beside]
                else:
                    there[:-1] = row[1:] == row[:-1]
                    other[:-1] = bins[1:, beside]
            other[~there] = BINS
            parts.append(other + (d + side * len(beside) + np.arange(len(beside))) * (BINS + 1))
        return np.concatenate(parts, 1)

    def marginals(self, odds: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(probability that a line is good, expected count of each label pair), by forward-backward over
        all documents at once, one step per line number."""
        counts = np.bincount(row, minlength=rows)
        by_size = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[by_size]
        counts = counts[by_size]
        local = np.stack([np.zeros(len(odds)), odds], 1)
        forward, backward = local.copy(), np.zeros_like(local)
        steps = int(counts[0]) if rows else 0
        live = [int(np.searchsorted(-counts, -k, "left")) for k in range(1, steps + 1)]  # documents with more than k lines
        log_sum = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
        for k in range(1, steps):
            at = first[: live[k - 1]] + k
            forward[at] += log_sum(forward[at - 1][:, :, None] + self.pair, 1)
        for k in range(steps - 1, 0, -1):
            at = first[: live[k - 1]] + k
            backward[at - 1] = log_sum((local[at] + backward[at])[:, None, :] + self.pair, 2)
        both = forward + backward
        p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        inner = np.flatnonzero(row[1:] == row[:-1]) + 1
        joint = forward[inner - 1][:, :, None] + self.pair + (local + backward)[inner][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        joint /= joint.sum((1, 2), keepdims=True)
        return p, joint.sum(0)

    def document_odds(self, stats: np.ndarray, row: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
        """Log odds of the length-weighted share of good lines."""
        odds = self.weights[self.active(stats, row)].sum(1)
        p, _ = self.marginals(odds, row, rows)
        weight = np.maximum(size, 1).astype(float)
        share = np.bincount(row, p * weight, rows) / np.maximum(np.bincount(row, weight, rows), 1e-9)
        share = np.clip(share, 1e-4, 1 - 1e-4)
        return np.log(share / (1 - share))

    def score(self, stats: np.ndarray, row: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
        z = self.slope * self.document_odds(stats, row, size, rows) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(documents: DataFrame, labels: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, steps: int = 60) -> LineField | None:
    """Fits on at most sample_documents labelled documents whose crc32(doc_id) mod 4 is not 2, and on at most
    SAMPLE_LINES lines of each, from a place that a hash of the text decides on; None if either class has
    none. Line statistics are made by tasks; only these reach the driver."""
    chosen = labels.where("quality is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_documents)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))

    def lines(piece: pa.RecordBatch) -> pa.RecordBatch:
        t = Texts(piece.column(1))
        stats, row, size = line_statistics(t)
        of_row = np.arange(len(row)) - np.searchsorted(row, row)
        spare = np.maximum(np.bincount(row, minlength=t.n) - SAMPLE_LINES, 0)
        begin = (t.span_hash(t.bounds[:-1], t.bounds[1:]) % (spare + 1).astype(np.uint64)).astype(np.int64)
        keep = (of_row >= begin[row]) & (of_row < begin[row] + SAMPLE_LINES)
        stats, row, size = stats[keep], row[keep], size[keep]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=t.n))]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(ends * stats.shape[1]), pa.array(stats.ravel()))
        return pa.record_batch([piece.column(0), piece.column(2), flat, pa.ListArray.from_arrays(pa.array(ends), pa.array(size.astype(np.int64)))], ["doc_id", "quality", "stats", "size"])

    got = over_texts(rows, lines, "doc_id long, quality int, stats array<double>, size array<long>").toPandas().sort_values("doc_id", kind="stable")
    if got["quality"].nunique() < 2:
        return None
    d = len(STATISTICS)
    stats = np.concatenate([np.asarray(s, float).reshape(-1, d) for s in got["stats"]])
    size = np.concatenate([np.asarray(s) for s in got["size"]])
    counts = np.array([len(s) for s in got["size"]])
    row = np.repeat(np.arange(len(got)), counts)
    label = got["quality"].to_numpy(float)
    y = label[row]
    cuts = [np.unique(np.quantile(stats[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    field = LineField(cuts, np.zeros((d + 2 * len(NEIGHBOURS)) * (BINS + 1)), np.zeros((2, 2)))
    on = field.active(stats, row)
    # each document weighs alike, and both classes together
    weight = 1 / counts[row] / np.where(y > 0, label.sum(), (1 - label).sum())
    inner = row[1:] == row[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
    m = v = 0.0
    mp = vp = np.zeros((2, 2))
    for step in range(1, steps + 1):  # Adam on the conditional likelihood
        p, pairs = field.marginals(field.weights[on].sum(1), row, len(got))
        grad = np.bincount(on.ravel(), np.repeat((p - y) * weight, on.shape[1]), len(field.weights)) + 1e-4 * field.weights
        pair_grad = (pairs - seen) / max(inner.sum(), 1) + 1e-2 * field.pair
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mp, vp = 0.9 * mp + 0.1 * pair_grad, 0.99 * vp + 0.01 * pair_grad**2
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        field.weights = field.weights - 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        field.pair = field.pair - 0.05 * (mp / c1) / (np.sqrt(vp / c2) + 1e-8)
    z = field.document_odds(stats, row, size, len(got))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic calibration
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - label) * z).sum() + 0.1 * (a - 1), (p - label).sum() + 0.1 * b])
        q = p * (1 - p)
        hess = np.array([[(q * z * z).sum() + 0.1, (q * z).sum()], [(q * z).sum(), q.sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, g)
    field.slope, field.offset = float(max(a, 0.0)), float(b)
    return field


def score_documents(documents: DataFrame, field: LineField | None, good_at: float = GOOD_AT) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines: one row per document.

    Null and empty texts are one empty line and are scored as such; without a field (no labels of both
    kinds) every score is 0.5. Repeated rows give a row each; further columns are ignored.
    """

    def rate(piece: pa.RecordBatch) -> pa.RecordBatch:
        t = Texts(piece.column(1))
        stats, row, size = line_statistics(t)
        s = field.score(stats, row, size, t.n) if field is not None else np.full(t.n, 0.5)
        return pa.record_batch([piece.column(0), pa.array(s), pa.array((s >= good_at).astype(np.int32)), pa.array(np.bincount(row, minlength=t.n))], ["doc_id", "score", "predicted", "n_lines"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = over_texts(chosen, rate, "doc_id long, score double, predicted int, n_lines long")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_lines")
