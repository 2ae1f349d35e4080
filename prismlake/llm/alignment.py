"""Alignment of two tokenizers: which tokens of one overlap which of the other, in every document.

The tokens of a text tile its bytes, by either tokenizer. The texts of a part of an Arrow batch lie one after the
other on one axis of bytes, so tokens are intervals in two DuckDB tables, inside the task: an ASOF join finds
the token of the other side that holds the start of an interval, which gives every overlapping pair once (the
later of two starts lies in both); places where both sides end cut the axis into groups, numbered by a window
sum. Spark adds up, by grouped aggregation, in how many documents each pair of ids is linked, from partial counts
of the tasks; the documents' own pairs then meet those counts.

Counts of the commonest pairs (MOST_SHARED at most, a bound on the broadcast) are looked up in the tasks; the
other pairs are joined with the table of counts. Results don't depend on where the line lies.

A text that is null, empty, or not the same bytes again from its tokens has no tokens: zeros and an empty digest.
Repeated rows are documents of their own. A very long text is taken in parts, cut between two words where both
tokenizers must cut. No documents: no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.packing import encoding
from prismlake.llm.staging import staged

#: Text of one DuckDB call, and from where on a text is taken in parts, in characters.
CALL, PART = 1 << 18, 1 << 18
#: Counts that are broadcast to the tasks.
MOST_SHARED = 1 << 20
#: Distinct pairs whose partial counts a task holds.
HELD = 1 << 20
#: A place where either tokenizer starts a token: a space between two letters.
_BETWEEN = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

_LINKS = """
SELECT part, key, CAST(count(*) AS INTEGER) AS n FROM (
  SELECT a.part, CAST(a.id AS BIGINT) * {width} + b.id AS key FROM a ASOF JOIN b ON a.s >= b.s
  UNION ALL
  SELECT a.part, CAST(a.id AS BIGINT) * {width} + b.id FROM b ASOF JOIN a ON b.s >= a.s WHERE b.s > a.s
) GROUP BY ALL ORDER BY part, key
"""
#: Tokens of one side in order: whether the other side ends there too, and how many common ends came before. The
#: tables are in order and there is one thread, so the window is summed as rows come, without a sort; s shows it.
_GROUPS = """
SELECT s, cut, sum(CAST(cut AS INTEGER)) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(cut AS INTEGER) AS g
FROM (SELECT s, e IN (SELECT e FROM {other}) AS cut FROM {side})
"""


class Sides:
    """The two tokenizers, the byte lengths of their ids, and DuckDB."""

    def __init__(self, a_path: str, b_path: str):
        import duckdb
        import sentencepiece

        self.a = encoding(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [self.a.decode_single_token_bytes(i) for i in range(self.a.max_token_value + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_flat, self.b_start = np.frombuffer(b"".join(self.b_bytes), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in self.b_bytes])])[:-1]
        self.divisible = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # text of a token and what follows it: side A has "," or "|", side B "," or ";"
        self.names = pa.array([f"{i}{end}" for table, mark in ((self.a_bytes, "|"), (self.b_bytes, ";")) for i in range(len(table)) for end in (",", mark)])
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.db.execute("SET enable_progress_bar = false")

    def parts(self, text: str, size: int) -> list[str]:
        """The text with a space before it, in parts of about `size` characters that begin with a space."""
        out, at = [], 0
        while self.divisible and len(text) - at > size and (m := _BETWEEN.search(text, at + size)):
            out.append((" " if not at else "") + text[at : m.start()])
            at = m.start()
        return [*out, (" " if not at else "") + text[at:]]

    def encode(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for each part; None where the bytes of the ids aren't the part."""
        want = [p.encode() for p in parts]
        a = [self.a.encode_to_numpy(p, allowed_special=set(), disallowed_special=()).astype(np.int32) for p in parts]
        b = [np.array(i, np.int32) for i in self.b.encode([p[1:] for p in parts], num_threads=1)]
        # A merges the text's own bytes and loses none; B may have changed some, so its bytes are laid out
        same = np.array([self.a_size[x].sum() == len(w) == self.b_size[y].sum() for x, y, w in zip(a, b, want, strict=True)])
        whole = np.flatnonzero(same)
        if len(whole):
            ids = np.concatenate([b[k] for k in whole])
            size = self.b_size[ids]
            at = np.repeat(self.b_start[ids] - (np.cumsum(size) - size), size)
            at += np.arange(len(at))
            wrong = self.b_flat[at] != np.frombuffer(b"".join(want[k] for k in whole), np.uint8)
            first = np.cumsum([0] + [len(want[k]) for k in whole])
            same[whole] = np.diff(np.concatenate([[0], np.cumsum(wrong)])[first]) == 0
        return [(x, y) if ok else None for x, y, ok in zip(a, b, same, strict=True)]

    def align(self, ids: list[tuple[np.ndarray, np.ndarray]]) -> list[Found]:
        """What is found in each part, of one pair of interval tables for all."""
        flat, ends = [], []
        for side, size in enumerate((self.a_size, self.b_size)):
            flat.append(np.concatenate([i[side] for i in ids]))
            ends.append(np.cumsum(size[flat[side]]))
            counts = [len(i[side]) for i in ids]
            # places of a call fit 32 bits, unless one part alone is longer
            kind = np.int32 if ends[side][-1] < 2**31 else np.int64
            table = pa.table({"part": np.repeat(np.arange(len(ids), dtype=np.int32), counts), "id": flat[side], "s": (ends[side] - size[flat[side]]).astype(kind), "e": ends[side].astype(kind)})
            self.db.register("ab"[side], table)
        links = self.db.execute(_LINKS.format(width=len(self.b_bytes))).fetchnumpy()
        sides = [self.db.execute(_GROUPS.format(side=x, other=y)).fetchnumpy() for x, y in ("ab", "ba")]
        if any((np.diff(g["s"]) <= 0).any() for g in sides):
            raise RuntimeError("token intervals came back out of order")
        (a_cut, a_group), (b_cut, b_group) = ((g["cut"], np.asarray(g["g"], np.int64)) for g in sides)
        # groups one after the other, of each A's tokens and then B's
        n = int(a_group[-1]) + 1
        a_count, b_count = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        text = np.empty(len(a_cut) + len(b_cut), np.int32)
        text[np.arange(len(a_cut)) + (np.cumsum(b_count) - b_count)[a_group]] = flat[0] * 2 + a_cut
        text[np.arange(len(b_cut)) + np.cumsum(a_count)[b_group]] = 2 * len(self.a_bytes) + flat[1] * 2 + b_cut
        begin = np.cumsum([0] + [len(i[0]) + len(i[1]) for i in ids])
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), self.names.take(pa.array(text))), "")
        at = np.searchsorted(links["part"], np.arange(len(ids) + 1))
        closed = np.concatenate([[0], np.cumsum(a_cut)])[np.cumsum([0] + [len(i[0]) for i in ids])]
        out = []
        for k, (a, b) in enumerate(ids):
            span = slice(at[k], at[k + 1])
            out.append(Found(len(a), len(b), int(closed[k + 1] - closed[k]), [texts[k].as_buffer()], [links["key"][span]], [links["n"][span]]))
        return out


@dataclass
class Found:
    """Counts of a document, its groups as text (each ended by a semicolon), its pairs and how often they link."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    text: list[pa.Buffer] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)

    def add(self, o: Found) -> None:
        self.n_a, self.n_b, self.n_groups = self.n_a + o.n_a, self.n_b + o.n_b, self.n_groups + o.n_groups
        self.text, self.keys, self.times = self.text + o.text, self.keys + o.keys, self.times + o.times

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) == 1:
            return self.keys[0], self.times[0]
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(at, np.concatenate(self.times), len(keys)).astype(np.int32)

    def digest(self) -> str:
        if not self.n_a:
            return ""
        state = hashlib.sha256()
        for k, text in enumerate(self.text):
            state.update(text if k + 1 < len(self.text) else text.slice(0, text.size - 1))
        return state.hexdigest()


LINKED_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, keys array<long>, times array<int>"
_sides: dict[tuple[str, str], Sides] = {}


def linked(documents: DataFrame, a_path: str, b_path: str, part: int = PART, call: int = CALL) -> DataFrame:
    """LINKED_SCHEMA: a row per document with its pairs (a's id times the size of B, plus b's id) and their links;
    and rows without a number, in which times are numbers of documents: the task's partial counts."""
    texts = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _sides:
            _sides[a_path, b_path] = Sides(a_path, b_path)
        sides = _sides[a_path, b_path]
        held: list[np.ndarray] = []  # keys of documents not yet counted
        counted = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting: list[tuple[int, int | None, list[str]]] = []
        size = 0

        def count() -> None:
            nonlocal counted, held
            keys, at = np.unique(np.concatenate([counted[0], *held]), return_inverse=True)
            counted = keys, np.bincount(at, np.concatenate([counted[1], np.ones(sum(map(len, held)))]), len(keys)).astype(np.int64)
            held = []

        def partial() -> pa.RecordBatch:
            nonlocal counted
            got, counted = counted, (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return _batch([(None, None, None, None, None, None, *got)])

        def flush() -> pa.RecordBatch:
            """The waiting documents, their parts encoded and aligned in calls of bounded size."""
            flat = [(k, p) for k, (_, _, parts) in enumerate(waiting) for p in parts]
            found = [Found() for _ in waiting]
            broken = set()
            at = 0
            while at < len(flat):
                end, chars = at, 0
                while end < len(flat) and (end == at or chars + len(flat[end][1]) <= call):
                    chars += len(flat[end][1])
                    end += 1
                ids = sides.encode([p for _, p in flat[at:end]])
                broken |= {k for (k, _), i in zip(flat[at:end], ids, strict=True) if i is None}
                good = [(k, i) for (k, _), i in zip(flat[at:end], ids, strict=True) if k not in broken]
                if good:
                    for (k, _), f in zip(good, sides.align([i for _, i in good]), strict=True):
                        found[k].add(f)
                at = end
            rows = []
            for k, (row, doc, _) in enumerate(waiting):
                f = Found() if k in broken else found[k]
                keys, times = f.pairs()
                held.append(keys)
                rows.append((row, doc, f.n_a, f.n_b, f.n_groups, f.digest(), keys, times))
            waiting.clear()
            return _batch(rows)

        for b in batches:
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py() or ""
                waiting.append((row, doc, sides.parts(text, part) if text else []))
                size += len(text) + 100
                if size > call:
                    yield flush()
                    size = 0
                if sum(map(len, held)) > HELD:
                    count()
                    if len(counted[0]) > HELD:
                        yield partial()
        if waiting:
            yield flush()
        if held:
            count()
        if len(counted[0]):
            yield partial()

    return texts.mapInArrow(link, LINKED_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in LINKED_SCHEMA.split(", ")])


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """key, docs, best: documents that hold the pair linked, and whether no pair of its A id has more."""
    counts = staged(pairs.where("row is null").select(F.explode(F.arrays_zip("keys", "times")).alias("p")).groupBy(F.col("p.keys").alias("key")).agg(F.sum(F.col("p.times").cast("long")).alias("docs")), "alignment-sums")
    # a row for each id of A, so the vocabulary bounds it
    top = counts.groupBy(F.expr(f"key div {width}").alias("a")).agg(F.max("docs").alias("top"))
    return counts.withColumn("a", F.expr(f"key div {width}")).join(F.broadcast(top), "a").select("key", "docs", (F.col("docs") == F.col("top")).alias("best"))


def align(documents: DataFrame, a_path: str, b_path: str, most_shared: int = MOST_SHARED, part: int = PART, call: int = CALL) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    pairs = staged(linked(documents, a_path, b_path, part, call), "alignment-pairs")
    counts = staged(pair_counts(pairs, width), "alignment-counts")
    # the commonest pairs: all of at least 2**k documents, for the least k that keeps within the bound
    steps = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("docs")).alias("k")).agg(F.count("*").alias("n")).collect()}
    least, n = max(steps, default=0) + 1, 0
    while least > 0 and n + steps.get(least - 1, 0) <= most_shared:
        least -= 1
        n += steps.get(least, 0)
    shared = counts.where(F.floor(F.log2("docs")) >= least).toArrow()
    order = np.argsort(shared["key"].to_numpy())
    told = documents.sparkSession.sparkContext.broadcast(tuple(shared[c].to_numpy()[order] for c in ("key", "docs", "best")))
    columns = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, best = told.value
        for b in batches:
            keys, times, at = b["keys"].values.to_numpy(), b["times"].values.to_numpy().astype(np.int64), b["keys"].offsets.to_numpy()
            place = np.minimum(np.searchsorted(key, keys), max(len(key) - 1, 0))
            known = key[place] == keys if len(key) else np.zeros(len(keys), bool)
            place = np.where(known, place, 0)
            weight = np.where(known, times, 0)
            sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[at])
            rest = np.concatenate([[0], np.cumsum(~known)])[at].astype(np.int32)
            out = {
                "row": b["row"], "doc_id": b["doc_id"], "n_a": b["n_a"], "n_b": b["n_b"], "n_groups": b["n_groups"], "n_links": pa.array(sums(times)),
                "n_best": pa.array(sums(weight * best[place]) if len(key) else sums(weight)), "count_sum": pa.array(sums(weight * docs[place]) if len(key) else sums(weight)), "groups_sha256": b["groups_sha256"],
                "keys": pa.ListArray.from_arrays(pa.array(rest), pa.array(keys[~known])), "times": pa.ListArray.from_arrays(pa.array(rest), pa.array(times[~known].astype(np.int32))),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    scored = pairs.where("row is not null").mapInArrow(look_up, f"row long, {columns}, keys array<long>, times array<int>")
    if not least:  # every pair is among the shared ones
        return scored.drop("row", "keys", "times")
    scored = staged(scored, "alignment-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("row", F.col("p.keys").alias("key"), F.col("p.times").alias("n"))
    more = rare.join(counts, "key").groupBy("row").agg(F.sum(F.col("n") * F.col("docs")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"))
    both = scored.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return both.select(*(c.split()[0] for c in columns.split(", ")))
