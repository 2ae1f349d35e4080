"""Quality rules: boosted trees over document statistics, behind two fixed base rules.

Statistics of a text come from one pass over its bytes inside a Spark task; the forest is small (some
hundreds of nodes), goes to the tasks with the function, and scores each slice as arrays. There is no
shuffle of texts anywhere: documents are read once for scoring, and once more for the labelled sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm import boosting
from prismlake.llm.textkernel import Texts, first_of_equal, mix, over_texts, segment_sum, shingle_hashes

#: Labelled rows used for fitting, at most (chosen by hash of doc_id): the bound of the driver's data.
SAMPLE_ROWS = 6000
#: A document stays if its probability of quality is at least this.
KEEP_AT = 0.5
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
REPEAT_WINDOW = 8

_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_MARKS = np.isin(np.arange(256), list(b".,;:!?"))
_BANG = np.isin(np.arange(256), list(b"!"))
_CONTINUES = (np.arange(256) & 0xC0) == 0x80

#: Statistic and the direction in which it may move the score (0: either).
FEATURES = {
    "log_words": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "word_length": 0, "upper_share": -1,
    "digit_share": 0, "mark_share": 0, "bang_share": -1, "distinct_share": 0, "line_words": 0, "same_as_last_share": -1,
}


def statistics(texts: Texts) -> dict[str, np.ndarray]:
    """Per row: the base counts of the contract, and the features as float columns."""
    t = texts
    words, rows = t.word_hash(), t.row_of_word
    n = t.n_words
    code_points = segment_sum(t.in_word & ~_CONTINUES[t.data], t.bounds)
    symbols = t.count(SYMBOLS)

    # words in windows that occur twice or more in their text
    windows, row, at = shingle_hashes(words, t.first, REPEAT_WINDOW)
    full = n[row] >= REPEAT_WINDOW
    windows, row, at = windows[full], row[full], at[full]
    order, new = first_of_equal(mix(windows + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    run = np.cumsum(new) - 1
    often = np.bincount(run, minlength=1)[run] > 1 if len(run) else np.zeros(0, bool)
    cover = np.zeros(len(words) + 1, np.int64)
    hit = at[order[often]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + REPEAT_WINDOW, -1)
    repeated = segment_sum(np.cumsum(cover[:-1]) > 0, t.first)

    # lines equal to an earlier line of their text; words of each line by where the line ends
    ls, le, lrow = t.lines()
    line_words = np.searchsorted(t.starts, le) - np.searchsorted(t.starts, ls)
    has = line_words > 0
    hashes = mix(t.span_hash(ls[has], le[has]) + lrow[has].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order, new = first_of_equal(hashes)
    dup_lines = np.bincount(lrow[has][order[~new]], minlength=t.n)
    lines = np.bincount(lrow[has], minlength=t.n)

    order, new = first_of_equal(mix(words + rows.astype(np.uint64) * np.uint64(0x165667B19E3779F9)))
    distinct = np.bincount(rows[order[new]], minlength=t.n)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    chars = np.maximum(code_points, 1)
    per_word = np.maximum(n, 1)
    return {
        "n_words": n, "word_chars": code_points, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated,
        "log_words": np.log1p(n), "symbol_share": symbols / chars, "dup_line_share": dup_lines / np.maximum(lines, 1), "repeat_share": repeated / per_word,
        "word_length": code_points / per_word, "upper_share": t.count(_UPPER) / chars, "digit_share": t.count(_DIGIT) / chars, "mark_share": t.count(_MARKS) / chars,
        "bang_share": t.count(_BANG) / chars, "distinct_share": distinct / per_word, "line_words": np.log1p(n / np.maximum(lines, 1)), "same_as_last_share": segment_sum(same, t.first) / per_word,
    }


BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> boosting.Forest | None:
    """Fits the forest on at most sample_rows labelled documents; None if either class has no document.

    Statistics are computed by Spark tasks; only their numbers come to the driver.
    """
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int").alias("quality"))

    def features(piece: pa.RecordBatch) -> pa.RecordBatch:
        s = statistics(Texts(piece.column(0)))
        return pa.record_batch([pa.array(s[k].astype(np.float64)) for k in FEATURES] + [piece.column(1)], [*FEATURES, "quality"])

    got = over_texts(rows, features, ", ".join(f"{k} double" for k in FEATURES) + ", quality int").toPandas()
    if got["quality"].nunique() < 2:
        return None
    got = got.sort_values(list(got.columns))  # the order of tasks doesn't matter then
    return boosting.fit(got[list(FEATURES)].to_numpy(), got["quality"].to_numpy(float), np.array(list(FEATURES.values())))


def score_documents(documents: DataFrame, forest: boosting.Forest | None, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every document.

    base_failed: under 20 words, or more than 30 % of words inside windows of 8 words that the text
    repeats. kept: not base_failed, and the forest's probability is at least keep_at. Without a forest
    (no labels of both kinds) the score is null and the base rules alone decide. Null and empty texts
    have 0 words and fail; repeated doc_ids give a row each; further columns are ignored.
    """

    def rate(piece: pa.RecordBatch) -> pa.RecordBatch:
        s = statistics(Texts(piece.column(1)))
        failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
        if forest is None:
            score, good = pa.nulls(len(failed), pa.float64()), ~failed
        else:
            p = forest.probability(np.stack([s[k] for k in FEATURES], 1).astype(np.float64))
            score, good = pa.array(p), ~failed & (p >= keep_at)
        return pa.record_batch(
            [piece.column(0), *(pa.array(s[k].astype(np.int64)) for k in BASE_COUNTS), pa.array(failed), score, pa.array(good)], ["doc_id", *BASE_COUNTS, "base_failed", "score", "kept"]
        )

    return over_texts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rate, "doc_id long, " + ", ".join(f"{k} long" for k in BASE_COUNTS) + ", base_failed boolean, score double, kept boolean")


def keep_good(documents: DataFrame, forest: boosting.Forest | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that pass, with all their columns (whatever their names), in one pass without a join."""
    at = documents.columns.index("text")

    def passing(piece: pa.RecordBatch) -> pa.RecordBatch:
        s = statistics(Texts(piece.column(at)))
        good = ~((s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"]))
        if forest is not None:
            good &= forest.probability(np.stack([s[k] for k in FEATURES], 1).astype(np.float64)) >= keep_at
        return piece.filter(pa.array(good))

    return over_texts(documents, passing, documents.schema)
