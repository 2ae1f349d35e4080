"""Best-fit packing of documents into training sequences under several capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces of one length are alike to the packer, so it never sees the pieces: Spark counts
them by length (one row per length: 1024 at most, whatever the corpus), the driver plans on those
counts, and Spark deals the pieces to the plan by their rank within their length. Sequences in the
same state (equal residual vector) are planned together, so that the plan's size follows the number
of states, not the corpus.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.staging import staged
from prismlake.llm.textkernel import sliced

TOKENS = 1024
END_ID = 2
#: Pieces that a task orders at once: those of one length are dealt over so many runs.
ROWS_A_RUN = 20_000

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The byte-level BPE of a tokenizers JSON file, as an encoder that returns numpy ids.

    Ids are those of tokenizers.Tokenizer.from_file(path) with encode_special_tokens (tests compare
    the two): merges of this kind rank as their ids do, so the vocabulary's ids serve as the ranks.
    """
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _encodings[path] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer_path: str, limit: int = TOKENS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The token pieces of every document: ids then end_id, cut into `limit`-token pieces where longer.

    The first piece takes what is left over, so only it may be shorter. Null text: empty (one id).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer_path).encode_to_numpy
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "", disallowed_special=()).astype("<u4"), np.uint32(end_id)).astype("<u4")
                head = len(ids) % limit or limit
                for k, start in enumerate([0, *range(min(head, len(ids)), len(ids), limit)]):
                    part = ids[start : head if not k else start + limit]
                    for column, value in zip(out, (doc_id, k, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.record_batch([pa.array(c, t) for c, t in list(zip(out, types, strict=True))[: 5 + keep_ids]], names[: 5 + keep_ids])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE_SCHEMA + ", ids array<int>" * keep_ids)


class Plan:
    """Vector best fit over counts of lengths. rows: (length, first rank, last rank + 1, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 1.0, 1.0), select: str = "norm"):
        if select not in ("norm", "dot"):
            raise ValueError(f"select must be norm or dot, not {select!r}")
        self.capacity = np.array(capacity, np.float64)
        self.weights = np.array(weights, np.float64)
        self.select = select
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        #: residual vector -> ranges (first sequence, how many) in that state
        self.open: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for length in sorted(counts, reverse=True):
            self._place(length, counts[length])

    def _best(self, need: np.ndarray) -> tuple[int, int, int] | None:
        if not self.open:
            return None
        states = np.array(list(self.open))
        fits = (states >= need).all(1)
        if not fits.any():
            return None
        states = states[fits]
        if self.select == "norm":  # the least weighted norm of what would be left
            score = -(self.weights * ((states - need) / self.capacity) ** 2).sum(1)
        else:  # the largest weighted dot product of demand and residual
            score = (self.weights * (states / self.capacity) * (need / self.capacity)).sum(1)
        return tuple(int(v) for v in states[int(np.argmax(score))])

    def _fill(self, state: tuple[int, int, int], need: np.ndarray, first: int, n: int, each: int, length: int, rank: int) -> None:
        """Puts `each` pieces into each of n sequences from `first`; keeps the state that results."""
        used = int(self.capacity[0]) - state[0]
        for k in range(each):
            self.rows.append((length, rank + k * n, rank + (k + 1) * n, first, used + k * length))
        left = tuple(int(v) for v in np.array(state) - each * need)
        if left[0] > 0 and left[1] > 0 and left[2] > 0:
            self.open.setdefault(left, []).append((first, n))

    def _place(self, length: int, count: int) -> None:
        need = np.array([length, 1, length * length])
        rank = 0
        while count:
            state = self._best(need)
            if state is None:
                whole = tuple(int(v) for v in self.capacity)
                each = int(min(c // d for c, d in zip(whole, need, strict=True)))
                if not each:
                    raise ValueError(f"a piece of {length} tokens fits no empty sequence")
                n = count // each
                groups = [(self.sequences, n, each)] if n else []
                if count % each:
                    groups.append((self.sequences + n, 1, count % each))
                self.sequences += n + bool(count % each)
                state = whole
            else:
                # under the dot rule a filled sequence loses its place, so it takes one piece at a time
                each = int(min(c // d for c, d in zip(state, need, strict=True))) if self.select == "norm" else 1
                first, have = self.open[state].pop()
                if not self.open[state]:
                    del self.open[state]
                n = min(have, count // each)
                rest = count - n * each
                groups = [(first, n, each)] if n else []
                if n < have:
                    if 0 < rest < each:
                        groups.append((first + n, 1, rest))
                        n += 1
                    if n < have:
                        self.open.setdefault(state, []).append((first + n, have - n))
            for first, n, each in groups:
                self._fill(state, need, first, n, each, length, rank)
                rank += n * each
                count -= n * each

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length, first rank) with their first rank, sequence and offset."""
        rows = np.array(sorted((a, b, s, o) for a, b, _, s, o in self.rows), np.int64).reshape(-1, 4)
        return (rows[:, 0] << 44) + rows[:, 1], rows[:, 1], rows[:, 2], rows[:, 3]


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    tokens: int = TOKENS,
    documents_per_sequence: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    select: str = "norm",
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Capacities default to what the token capacity implies, and then bind nothing further; set lower,
    they hold for every sequence. Repeated rows are packed each; a null or empty text is its end id; a
    text longer than a sequence is cut; no documents: no rows. Offsets of a sequence leave no gaps.
    Columns other than doc_id and text are ignored.
    """
    attention = attention or tokens * tokens
    per = documents_per_sequence or tokens
    limit = min(tokens, math.isqrt(attention))
    cut = staged(pieces(documents, tokenizer_path, limit, end_id, keep_ids).withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")), "pieces")
    # a length has as many runs as its pieces fill: a row to the driver for each length and each ROWS_A_RUN pieces
    runs = np.ones(limit + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        runs[r["length"]] = -(-r["n"] // ROWS_A_RUN)
    cut = cut.withColumn("run", F.pmod("h", F.get(F.lit(runs.tolist()), F.col("length").cast("int"))).cast("int")).drop("h")
    sizes = cut.groupBy("length", "run").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "run"])
    plan = Plan(sizes.groupby("length")["n"].sum().to_dict(), (tokens, per, attention), weights, select)
    keys, first, sequence, place = plan.lookup()
    before = (sizes.groupby("length")["n"].cumsum() - sizes["n"]).to_numpy(np.int64)
    run_keys = (sizes["length"].to_numpy(np.int64) << 32) + sizes["run"].to_numpy(np.int64)

    within = Window.partitionBy("length", "run").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            length = column["length"].to_numpy()
            rank = column["rank"].to_numpy().astype(np.int64) + before[np.searchsorted(run_keys, (length.astype(np.int64) << 32) + column["run"].to_numpy())]
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            out = [c for k, c in column.items() if k not in ("run", "rank")] + [pa.array(sequence[at] + rank - first[at]), pa.array(place[at])]
            yield pa.record_batch(out, [k for k in column if k not in ("run", "rank")] + ["sequence_id", "offset"])

    return ranked.mapInArrow(assign, PIECE_SCHEMA + ", ids array<int>" * keep_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pack(..., keep_ids=True): sequence_id, ids, doc_ids, starts of the pieces."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets")
    )
