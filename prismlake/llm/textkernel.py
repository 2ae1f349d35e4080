"""Vectorised word, line and shingle arithmetic over Arrow string columns.

Everything here works on one slice of an Arrow batch inside a Spark task: the UTF-8 bytes of all texts
of the slice are seen as one numpy array, so no Python loop runs over words. A word is a maximal run
of characters other than space and U+0009 to U+000D, in every operator that does not say otherwise.

Words, lines and shingles are compared by 64-bit hashes of their whole content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INVERSE = pow(_BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the table is kept and grows by doubling."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 23:
            _powers[base] = have
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public SplitMix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; empty segments give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Texts:
    """The texts of one slice: bytes, row bounds, words. A null text is the empty text."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if lower:
            column = pc.utf8_lower(column)
        self.column = column
        raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        body = column.buffers()[2]
        whole = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.data = whole[raw[0] : raw[-1]]
        self.bounds = raw - raw[0]
        self.n = len(column)
        self._prefix: np.ndarray | None = None
        self._words()

    def _words(self) -> None:
        data, bounds = self.data, self.bounds
        space = IS_SPACE[data]
        self.in_word = ~space
        size = len(data)
        before = np.empty(size, bool)
        after = np.empty(size, bool)
        if size:
            before[0] = after[-1] = True
            before[1:] = space[:-1]
            after[:-1] = space[1:]
            before[bounds[:-1][bounds[:-1] < size]] = True
            ends = bounds[1:]
            after[ends[ends > 0] - 1] = True
        self.starts = np.flatnonzero(self.in_word & before)
        self.ends = np.flatnonzero(self.in_word & after) + 1
        self.first = np.searchsorted(self.starts, bounds)  # words of row i: first[i]:first[i + 1]
        self.n_words = np.diff(self.first)

    @property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans; equal bytes have equal hashes wherever they stand."""
        if self._prefix is None:
            size = len(self.data)
            self._prefix = np.zeros(size + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * _power(_BASE, size)[:size], out=self._prefix[1:])
        h = (self._prefix[ends] - self._prefix[starts]) * _power(_BASE_INVERSE, len(self.data))[starts]
        return mix(h + (ends - starts).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, first word) of each window of `width` words.

        A text of fewer words (but one at least) has one shingle, of all its words.
        """
        return shingle_hashes(self.word_hash(), self.first, width)

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each row for which the 256-entry table is true."""
        return segment_sum(table[self.data], self.bounds)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of the \\n-split lines; a row of k newlines has k + 1 lines."""
        cuts = np.flatnonzero(self.data == 10)
        per_row = np.searchsorted(cuts, self.bounds[1:]) - np.searchsorted(cuts, self.bounds[:-1]) + 1
        row = np.repeat(np.arange(self.n), per_row)
        starts = np.sort(np.concatenate([self.bounds[:-1], cuts + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.bounds[1:], cuts]), kind="stable")
        return starts, ends, row


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(words)
    counts = np.diff(first)
    per_row = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), per_row)
    skipped = np.cumsum(counts - per_row) - (counts - per_row)
    at = np.arange(len(row)) + skipped[row] if len(row) else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    last = first[1:][row] if len(row) else at
    for k in range(width):
        inside = at + k < last
        value = words[np.minimum(at + k, max(n - 1, 0))] if n else h
        h = h * STEP + np.where(inside, value, np.uint64(0))
    return mix(h), row, at


def first_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start flags): a stable sort of the keys and where each run of equal keys begins."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, new


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice has at most `limit` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def over_texts(df, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, column: str = "text"):
    """df.mapInArrow with the batches cut to bounded slices; None gives no rows."""

    def run(batches):
        for piece in sliced(batches, column):
            out = function(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
