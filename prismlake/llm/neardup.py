"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset verification.

A document is the multiset of its five-word shingles (lower-cased). Two documents are linked if the
weighted Jaccard similarity of their multisets is 0.8 or more; classes are the connected components.

Signature. Each shingle of weight w owns Poisson processes over the blocks (0, 1], (1, 2], (2, 4],
(4, 8] ... of its weight axis, driven by hashes of (shingle, block, number of the point): a point has
an arrival time, a place in its block and a signature component, and counts if its place is within w.
A component's value is the first arrival in it. Two multisets agree in a component with probability
equal to their weighted Jaccard similarity. Points come in order of time, so a process ends as soon as
its next point is later than the latest component (few points per shingle in a long text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm import bitmaps
from prismlake.llm.staging import components, staged
from prismlake.llm.textkernel import Texts, first_of_equal, mix, over_texts

WIDTH = 5
THRESHOLD = 0.8
#: At similarity 0.8 a pair shares a band with probability 0.99985, at 0.5 with 0.17.
BANDS, ROWS = 48, 8
#: Bits of each signature component that a sketch keeps, and the standard deviations under the expected
#: number of equal ones at the threshold from which a pair is no longer compared in full.
PLANES, DEVIATIONS = 4, 4
#: Anchors of a bucket in a round, times those of the round before.
SLOTS = 64


def bag(t: Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, weight) of the distinct shingles of each row."""
    h, row, _ = t.shingles(width)
    order, new = first_of_equal(mix(h + mix(row.astype(np.uint64))))
    starts = np.flatnonzero(new)
    weight = np.diff(np.append(starts, len(h)))
    return h[order[starts]], row[order[starts]], weight


def signatures(h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, size: int = BANDS * ROWS) -> np.ndarray:
    """rows x size arrival times; a row without shingles has inf everywhere."""
    values = np.full(rows * size, np.inf)
    latest = np.full(rows, np.inf)
    top = int(weight.max()).bit_length() + 1 if len(weight) else 0
    parts = []
    for block in range(top):
        low = 0 if not block else 1 << (block - 1)
        on = np.flatnonzero(weight > low)
        if len(on):
            parts.append((mix(h[on] + np.uint64((block + 1) * 0x632BE59BD9B4E019 % 2**64)), row[on], weight[on], np.full(len(on), low), np.full(len(on), max(1, low))))
    if not parts:
        return values.reshape(rows, size)
    key, r, w, low, length = (np.concatenate(c) for c in zip(*parts, strict=True))
    time = np.zeros(len(key))
    n = 0
    while len(key):
        n += 1
        u = mix(key + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        live = time < latest[r]
        key, r, w, low, length, time, u = key[live], r[live], w[live], low[live], length[live], time[live], u[live]
        v = mix(u ^ np.uint64(0xA0761D6478BD642F))
        component = ((v >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        place = low + 1 + (v & np.uint64(0xFFFFFFFF)).astype(np.int64) % length
        counts = place <= w
        np.minimum.at(values, r[counts] * size + component[counts], time[counts])
        touched = np.unique(r)
        latest[touched] = values.reshape(rows, size)[touched].max(1)
    return values.reshape(rows, size)


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per row and band, of the arrival times in it."""
    bits = values.view(np.uint64).reshape(len(values), bands, rows)
    key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(values), 1))
    for k in range(rows):
        key = mix(key ^ bits[:, :, k])
    return key


def sketches(values: np.ndarray) -> np.ndarray:
    """PLANES bits of each component, a bit plane after the other, as 64-bit words (row by row)."""
    v = mix(values.view(np.uint64))
    short = -values.shape[1] % 64
    planes = [np.pad(((v >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), ((0, 0), (0, short))) for p in range(PLANES)]
    return np.concatenate([np.packbits(b, axis=1).view(np.uint64) for b in planes], axis=1)


def may_be_similar(x: str, y: str, threshold: float, size: int) -> Column:
    """Whether two sketches of `size` components leave it open that the similarity reaches the threshold."""
    words = -(-size // 64)
    differ = [" | ".join(f"({x}[{p * words + w}] ^ {y}[{p * words + w}])" for p in range(PLANES)) for w in range(words)]
    equal = threshold + (1 - threshold) / 2**PLANES
    most = size * (1 - equal) + DEVIATIONS * (size * equal * (1 - equal)) ** 0.5
    return F.expr(" + ".join(f"bit_count({d})" for d in differ)) <= most


def signed(documents: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key (128-bit hash of the lower-cased text), size (shingles), bands (null for a text without words), sketch."""

    def sign(piece: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        t = Texts(piece.column(1), lower=True)
        values = signatures(*bag(t, width), t.n, bands * rows)
        keys, short = band_keys(values, bands, rows), sketches(values)
        text_keys = [xxhash.xxh3_128_digest(t.data[a:b]) for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
        empty = pa.array(t.n_words == 0)
        size = np.maximum(t.n_words - width + 1, np.minimum(t.n_words, 1))
        sketch = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1) * short.shape[1], pa.int32()), pa.array(short.view(np.int64).ravel()))
        columns = [piece.column(0), pa.array(text_keys, pa.binary()), pa.array(size), pa.compute.if_else(empty, pa.scalar(None, lists.type), lists), sketch]
        return pa.record_batch(columns, ["doc_id", "text_key", "size", "bands", "sketch"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_texts(chosen, sign, "doc_id long, text_key binary, size long, bands array<long>, sketch array<long>")


def bags(documents: DataFrame, wanted: np.ndarray, width: int = WIDTH) -> DataFrame:
    """id, bag of the documents that the bitmap passes. A bag holds a hash per shingle and repetition, so
    that multiset overlap is set overlap."""
    bits = documents.sparkSession.sparkContext.broadcast(wanted)

    def collect(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = piece.column(0).fill_null(0).to_numpy()
        piece = piece.filter(pa.array(bitmaps.probe(bits.value, mix(ids.astype(np.uint64)))))
        if not piece.num_rows:
            return None
        t = Texts(piece.column(1), lower=True)
        h, row, _ = t.shingles(width)
        order, new = first_of_equal(mix(h + mix(row.astype(np.uint64))))
        starts = np.flatnonzero(new)
        repeat = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
        element = np.empty(len(h), np.uint64)
        element[order] = mix(h[order] + repeat.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=t.n))])
        return pa.record_batch([piece.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(element.view(np.int64)))], ["id", "bag"])

    chosen = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_texts(chosen, collect, "id long, bag array<long>")


def similar(pairs: DataFrame, multisets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b, and what else they have) with their weighted Jaccard similarity and whether it reaches the threshold."""
    a = multisets.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    b = multisets.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    both = pairs.join(b, "b").join(a, "a").withColumn("shared", F.size(F.array_intersect("bag_a", "bag_b")))
    jaccard = F.col("shared") / (F.size("bag_a") + F.size("bag_b") - F.col("shared"))
    return both.select(*pairs.columns, jaccard.alias("similarity"), (jaccard >= threshold).alias("linked"))


def links(documents: DataFrame, signs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, size: int = BANDS * ROWS) -> DataFrame:
    """a, b, similarity: verified links that connect all texts which a chain of links connects. Ids are the
    least doc_id of each text.

    Members of a band bucket are compared with anchors of it, never all with all. At first anchors
    are the members with the fullest buckets in every bucket they are in, mostly the texts that others were
    copied from; an anchor of one bucket is an anchor of all its buckets, and leaves them when it has been compared with every member
    it is not connected to yet. A bucket ends when its members are connected. Every pair of a bucket is
    thus connected, compared (once, in the first bucket of the two), or ruled out: by sizes of which one is
    under the threshold times the other, or by sketches that differ too much. Later rounds take their
    anchors from outside of the bucket's largest component, SLOTS times as many as the round before, so
    that rounds grow with the logarithm of what is left unconnected.
    """
    spark = documents.sparkSession
    members = signs.where("bands is not null").groupBy("text_key").agg(F.min("doc_id").alias("doc"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    texts = staged(members.where("doc is not null"), "distinct")
    members = texts.select("doc", F.posexplode("bands").alias("band", "bucket"))
    full = staged(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    left = staged(members.join(full, "bucket"), "bucketed")
    weight = left.groupBy("doc").agg(F.sum("n").alias("weight"))
    facts = staged(weight.join(texts.select("doc", "size", "sketch", "bands"), "doc"), "facts")
    wanted = bitmaps.build_ids(facts.select("doc"), "doc")
    multisets = staged(bags(documents, wanted, width).dropDuplicates(["id"]), "bags")
    left = staged(left.join(facts.select("doc", "weight"), "doc").select("bucket", "band", "doc", "weight", F.col("doc").alias("part")), "left", (rows := left.count()))
    done = None
    slots = 0
    while not left.isEmpty():
        outside = left
        if done is not None:
            parts = left.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "part"))["part"].alias("largest"))
            outside = left.join(parts, "bucket").where("part <> largest")
        best = outside.groupBy("bucket", F.pmod(F.xxhash64("doc"), F.lit(max(1, slots))).alias("slot")).agg(F.max(F.struct("weight", (-F.col("doc")).alias("doc")))["doc"].alias("doc"))
        chosen = best.select("bucket", (-F.col("doc")).alias("doc"), F.lit(True).alias("leads"))
        if done is None:
            chosen = left.join(chosen, ["bucket", "doc"], "left").groupBy("doc").agg((F.count("leads") == F.count("*")).alias("leads")).where("leads")
        anchors = staged(chosen.select("doc", "leads").distinct(), "anchors", rows)
        known = staged(left.join(facts.drop("weight"), "doc").join(anchors, "doc", "left"), "known", rows)
        own = known.where("leads").select("bucket", *(F.col(c).alias(f"its_{c}") for c in ("doc", "part", "size", "sketch", "bands")))
        new = F.col("leads").isNull() | (F.col("doc") > F.col("its_doc"))
        sizes = F.least("size", "its_size") >= threshold * F.greatest("size", "its_size") - 1e-9
        first = F.expr("not arrays_overlap(slice(bands, 1, band), slice(its_bands, 1, band))")
        met = known.join(own, "bucket").where((F.col("part") != F.col("its_part")) & new & sizes & may_be_similar("sketch", "its_sketch", threshold, size) & first)
        pairs = staged(met.select(F.col("doc").alias("a"), F.col("its_doc").alias("b"), "part", "its_part"), "pairs")
        good = staged(similar(pairs, multisets, threshold).where("linked"), "linked")
        done = good.select("a", "b", "similarity") if done is None else done.unionAll(good.select("a", "b", "similarity"))
        rest = known.where("leads is null").select("bucket", "band", "doc", "weight", "part")
        if not good.isEmpty():
            merged = staged(components(good.select("part", "its_part"), "part", "its_part"), "merged", rows).withColumnRenamed("id", "part")
            rest = rest.join(merged, "part", "left").select("bucket", "band", "doc", "weight", F.coalesce("component", "part").alias("part"))
        rest = staged(rest, "rest", rows)
        mixed = rest.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("bucket")
        left = staged(rest.join(mixed, "bucket"), "left", rows)
        slots = slots * SLOTS or 1
    return done if done is not None else spark.createDataFrame([], "a long, b long, similarity double")


def classes(documents: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, kept: one row per row of documents.

    class_id is the least doc_id of the class; kept is true for the row of that id. Texts equal but for
    case are one class. Null and empty texts (and texts of white space) are no copies of each other:
    each is a class of its own. A null doc_id has a null class_id and is kept. Rows of one doc_id and
    one text are one document. Further columns are ignored.
    """
    signs = staged(signed(documents, width, bands, rows), "signed")
    firsts = staged(signs.where("bands is not null and doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("rep")), "reps")
    found = links(documents, signs, threshold, width, bands * rows)
    joined = staged(components(found.select("a", "b")), "components")
    named = signs.select("doc_id", F.when(F.col("bands").isNotNull() & F.col("doc_id").isNotNull(), F.col("text_key")).alias("text_key"))
    rep = named.join(firsts, "text_key", "left")
    out = rep.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
    class_id = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One document of each class, with all its columns (of repeated rows of one doc_id, all)."""
    dropped = staged(classes(documents, **options).where("not kept").select(F.col("doc_id").alias("doc_id")).distinct(), "dropped")
    return documents.join(dropped, documents["doc_id"] == dropped["doc_id"], "left_anti")
