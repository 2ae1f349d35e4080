"""Benchmark decontamination: which documents hold (most of) a test item.

Containment search by bottom-k MinHash sketches over items partitioned by size. In a partition whose
items have at most u shingles, an item's sketch is its floor((1 - t) * u) + 1 least shingle hashes: a
document that holds a share t of the item's shingles misses at most floor((1 - t) * u) of them, so it
holds one of the sketch. Short items thus need short sketches, long documents none at all, and no
qualifying pair is lost. Candidates are verified on the shingles themselves, as text.

Documents pass through one map: a fixed-size bitmap of all sketch hashes lets nearly all of them go
at once, and only documents with a hit send rows (their shingles that any item has) to the joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm import bitmaps
from prismlake.llm.staging import staged
from prismlake.llm.textkernel import Texts, mix, over_texts, shingle_hashes

WIDTH = 5
THRESHOLD = 0.8


def _sets(t: Texts, width: int):
    """(hash, row, first word) of shingles of exactly `width` words, each once per row."""
    h, row, at = shingle_hashes(t.word_hash(), t.first, width)
    full = t.n_words[row] >= width
    h, row, at = h[full], row[full], at[full]
    # of another width: another hash
    h = mix(h + np.uint64(width))
    _, first = np.unique(mix(h ^ mix(row.astype(np.uint64))), return_index=True)
    first.sort()
    return h[first], row[first], at[first]


def _shingle_text(t: Texts, at: int, width: int) -> str:
    return " ".join(t.data[t.starts[k] : t.ends[k]].tobytes().decode("utf-8") for k in range(at, at + width))


def index_items(items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """item_id, width, size, size_class, sketch (hashes), hashes and shingles (text) of each item.

    Words are lower-cased. An item of fewer than `width` words is one shingle of its own width; an
    empty or null one has none and is left out.
    """

    def build(piece: pa.RecordBatch) -> pa.RecordBatch:
        t = Texts(piece.column(1), lower=True)
        out: list[list] = [[] for _ in range(7)]
        words = t.word_hash()
        for r, item in enumerate(piece.column(0).to_pylist()):
            n = int(t.n_words[r])
            if not n:
                continue
            w = min(width, n)
            first = np.array([0, n])
            h, _, at = shingle_hashes(words[t.first[r] : t.first[r + 1]], first, w)
            h, keep = np.unique(mix(h + np.uint64(w)), return_index=True)
            size_class = int(len(h) - 1).bit_length()
            bound = 1 << size_class
            sketch = h[: int((1 - threshold) * bound + 1e-9) + 1]
            row = (item, w, len(h), size_class, sketch.view(np.int64), h.view(np.int64), [_shingle_text(t, int(t.first[r] + at[k]), w) for k in keep])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.record_batch([pa.array(c, k) for c, k in zip(out, types, strict=True)], ["item_id", "width", "size", "size_class", "sketch", "hashes", "shingles"])

    return over_texts(
        items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")),
        build,
        "item_id long, width int, size long, size_class int, sketch array<long>, hashes array<long>, shingles array<string>",
    )


def contaminated(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, shared, size, containment of every pair with shared / size >= threshold.

    shared: distinct shingles of the item that the document has. Repeated document rows give one pair;
    repeated items (rows of one item_id with one text) too. Null or empty texts, an empty table of
    either side: no pairs. Further columns are ignored.
    """
    spark = documents.sparkSession
    index = staged(index_items(items, threshold, width), "items")
    widths = [r[0] for r in index.select("width").distinct().collect()]  # at most `width` values
    sketch_bits = bitmaps.build(index.select(F.explode("sketch").alias("h")), "h")
    all_bits = bitmaps.build(index.select(F.explode("hashes").alias("h")), "h")
    shared_bits = spark.sparkContext.broadcast((sketch_bits, all_bits))
    smallest = index.agg(F.min("size")).first()[0] or 0

    def hits(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        sketch_bits, all_bits = shared_bits.value
        t = Texts(piece.column(1), lower=True)
        out: dict[int, tuple[list, list]] = {}
        for w in widths:
            h, row, at = _sets(t, w)
            meet = bitmaps.probe(sketch_bits, h)
            if not meet.any():
                continue
            named = np.zeros(t.n, bool)
            named[row[meet]] = True
            take = np.flatnonzero(named[row] & bitmaps.probe(all_bits, h))
            for k in take:
                probes, texts = out.setdefault(int(row[k]), ([], []))
                texts.append(_shingle_text(t, int(at[k]), w))
                if meet[k]:
                    probes.append(int(h[k].view(np.int64)))
        if not out:
            return None
        rows = sorted(out)
        ids = piece.column(0).take(pa.array(rows))
        whole = t.span_hash(t.bounds[rows], t.bounds[np.array(rows) + 1])
        seed = np.array([hash(v) & (2**63 - 1) for v in ids.to_pylist()], np.uint64)
        return pa.record_batch(
            [pa.array((mix(seed) ^ whole).view(np.int64)), ids, pa.array([out[r][0] for r in rows], pa.list_(pa.int64())), pa.array([out[r][1] for r in rows], pa.list_(pa.string()))],
            ["row_key", "doc_id", "probes", "found"],
        )

    found = staged(
        over_texts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), hits, "row_key long, doc_id long, probes array<long>, found array<string>"),
        "found",
    )
    if not smallest:
        found = found.limit(0)
    probes = found.select("row_key", F.explode("probes").alias("h"))
    sketches = index.select("item_id", "size", F.explode("sketch").alias("h"))
    candidates = staged(probes.join(sketches, "h").select("row_key", "item_id").distinct(), "candidates")
    pairs = candidates.join(found.select("row_key", "doc_id", "found"), "row_key").join(index.select("item_id", "size", "shingles"), "item_id")
    rated = pairs.select("doc_id", "item_id", F.size(F.array_intersect("found", "shingles")).cast("long").alias("shared"), "size").where(F.col("shared") >= threshold * F.col("size") - 1e-9)
    best = rated.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("size")).alias("containment"), "shared", "size")).alias("b"))
    return best.select("doc_id", "item_id", "b.shared", "b.size", "b.containment")


def drop_contaminated(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    bad = staged(contaminated(documents, items, threshold).select(F.col("doc_id").alias("doc_id")).distinct(), "contaminated")
    return documents.join(bad, documents["doc_id"] == bad["doc_id"], "left_anti")
