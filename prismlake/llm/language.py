"""Language identification by fusing evidence: text, declared markup language, address suffix, host.

Text likelihoods are byte-trigram models of all documents with a declared language. For pages, the
languages that their texts suggest are then counted by declared language, by suffix and by host; these
counts give the likelihoods of a declaration and of a suffix, and the host prior, smoothed from host to
registered domain to suffix to all pages. The posterior multiplies them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.staging import staged
from prismlake.llm.textkernel import Texts, over_texts, segment_sum, sliced

BUCKETS = 1 << 14
#: Trigrams of a text are no independent witnesses: so many count in full, and the rest not at all.
WITNESSES = 40.0
#: Pseudo-counts of each level of the host prior, drawn from the level above.
STRENGTH = 5.0

_TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
#: What may stand before the html tag and hold another one, or the tag itself.
_HEAD = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<html\b[^>]*", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def _trigrams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each place, bounds of rows): trigrams of lower-cased bytes; those over a row's end are 0 wide."""
    d = t.data.astype(np.int32)
    if len(d) < 3:
        return np.zeros(0, np.int32), np.minimum(t.bounds, 0)
    h = (d[:-2] * 40503 + d[1:-1] * 25717 + d[2:] * 9973) & (BUCKETS - 1)
    return h, np.minimum(t.bounds, len(h))


class TextModel:
    def __init__(self, languages: list[str], log_prob: np.ndarray):
        self.languages, self.log_prob = languages, log_prob

    def log_likelihood(self, t: Texts) -> np.ndarray:
        """rows x languages: the mean trigram log probability times the witnesses that count."""
        h, bounds = _trigrams(t)
        n = np.diff(bounds)
        total = np.stack([segment_sum(column[h], bounds) for column in self.log_prob], 1) if len(self.languages) else np.zeros((t.n, 0))
        return total / np.maximum(n, 1)[:, None] * np.minimum(n, WITNESSES)[:, None]


def fit_text(documents: DataFrame) -> TextModel:
    """Counts trigrams by language over every document that declares one. The model has BUCKETS numbers
    for each language, and every language is in it."""
    names = sorted(r[0] for r in documents.where("lang is not null").select("lang").distinct().collect())
    place = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names) * BUCKETS, np.int64)
        for piece in sliced(batches):
            lang = np.array([place.get(x, -1) for x in piece.column(1).to_pylist()])
            t = Texts(piece.column(0), lower=True)
            h, bounds = _trigrams(t)
            each = np.repeat(lang, np.diff(bounds))
            total += np.bincount(each[each >= 0] * BUCKETS + h[each >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array((at // BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = documents.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), "lang")
    got = rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(names), BUCKETS), 0.5)
    counts[got["lang"].to_numpy(int), got["bucket"].to_numpy(int)] += got["n"].to_numpy(float)
    return TextModel(names, np.log(counts / counts.sum(1, keepdims=True)))


def plain_text(html: str) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", _TAGS.sub(" ", html)).strip()


def declared_language(html: str) -> str | None:
    """The language of the first html tag outside of comments and scripts, wherever it stands."""
    for m in _HEAD.finditer(html):
        if m.group()[:5].lower() == "<html":
            told = _DECLARED.match(m.group())
            return told.group(1).lower() if told else None
    return None


def _witness(rows: DataFrame, model: TextModel) -> DataFrame:
    """kind, id, host, suffix, declared, evidence (log likelihood per language), first (the likeliest)."""

    def read(piece: pa.RecordBatch) -> pa.RecordBatch:
        column = {n: piece.column(i) for i, n in enumerate(piece.schema.names)}
        kinds = column["kind"].to_pylist()
        texts, declared = [], []
        for kind, text in zip(kinds, column["text"].to_pylist(), strict=True):
            page = kind == "page"
            declared.append(declared_language(text) if page and text else None)
            texts.append(plain_text(text) if page and text else text)
        t = Texts(pa.array(texts, pa.string()), lower=True)
        like = model.log_likelihood(t)
        first = [model.languages[k] if t.n_words[i] else None for i, k in enumerate(like.argmax(1))] if len(model.languages) else [None] * t.n
        lists = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1) * like.shape[1], pa.int32()), pa.array(like.ravel()))
        return pa.record_batch([column["kind"], column["id"], column["host"], pa.array(declared, pa.string()), lists, pa.array(first, pa.string())], ["kind", "id", "host", "declared", "evidence", "first"])

    return over_texts(rows, read, "kind string, id long, host string, declared string, evidence array<double>, first string")


def identify(documents: DataFrame, pages: DataFrame, model: TextModel | None = None) -> DataFrame:
    """kind (document or page), doc_id or page_id, lang, probability, text_lang, declared, suffix, host.

    A document's host is its source; it has no suffix and no declared language (its lang column is what
    the text model learns from, and is not evidence for its own row). Null or empty texts are judged by
    what else is known; with no language known at all, lang is null. One row per row of both tables.
    """
    model = model or fit_text(documents)
    spark = documents.sparkSession
    rows = documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("source").alias("host"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#:]*)", 1))
    rows = rows.unionAll(pages.select(F.lit("page"), F.col("page_id").cast("long"), F.col("html").cast("string"), F.when(host != "", host)))
    seen = _witness(rows, model)
    seen = seen.withColumn("suffix", F.when(F.col("kind") == "page", F.element_at(F.split("host", "[.]"), -1)))
    seen = staged(seen.withColumn("domain", F.when(F.col("kind") == "page", F.array_join(F.slice(F.split("host", "[.]"), -F.least(F.size(F.split("host", "[.]")), F.lit(2)), 2), "."))), "seen")
    languages = model.languages
    if not languages:
        return seen.select("kind", *_ids(), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.col("first").alias("text_lang"), "declared", "suffix", "host")
    known = seen.where("first is not null")
    tally = lambda *keys: known.groupBy(*keys).agg(*(F.sum((F.col("first") == x).cast("double")).alias(f"n{i}") for i, x in enumerate(languages)))

    overall = np.array(tally(F.lit(1)).drop("1").first() or [0.0] * len(languages), float)[-len(languages) :]
    prior = (overall + 1) / (overall + 1).sum()
    # a row per declared language and per suffix: joined; only their totals are collected
    array = F.array(*(F.col(f"n{i}") for i in range(len(languages))))
    by_declared = staged(tally("declared").where("declared is not null").select("declared", array.alias("declared_n")), "by_declared")
    by_suffix = staged(tally("suffix").where("suffix is not null").select("suffix", array.alias("suffix_n")), "by_suffix")
    declared_total, suffix_total = _totals(by_declared, "declared_n", languages), _totals(by_suffix, "suffix_n", languages)

    def likelihood(total: np.ndarray, name: str | None, n: list[float] | None) -> np.ndarray:
        """p(name | language) with one pseudo-count for each name and one for unknown ones."""
        if name is None:
            return np.zeros(len(languages))
        return np.log(((0.0 if n is None else np.asarray(n, float)) + 1) / total)

    # the host prior needs a row per host: levels are joined, never collected
    by_host = staged(known.groupBy("kind", "host").agg(F.first("domain").alias("domain"), F.first("suffix").alias("suffix"), *(F.sum((F.col("first") == x).cast("double")).alias(f"n{i}") for i, x in enumerate(languages))).select("kind", "host", "domain", "suffix", array.alias("host_n")), "by_host")
    by_domain = staged(tally("domain").where("domain is not null").select("domain", array.alias("domain_n")), "by_domain")
    counts = staged(by_host.join(by_domain, "domain", "left").select("kind", "host", "host_n", "domain_n"), "host_counts")
    of_host = seen.where("suffix is not null").select("kind", "host", "suffix").distinct().join(by_suffix, "suffix").select("kind", "host", "suffix_n")
    joined = seen.join(staged(counts.join(of_host, ["kind", "host"], "full"), "host_all"), ["kind", "host"], "left")
    # most rows declare nothing: they don't go to one task of the join
    told = joined.where("declared is not null").join(by_declared, "declared", "left")
    joined = told.unionByName(joined.where("declared is null").withColumn("declared_n", F.lit(None).cast("array<double>")))

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            lang, probability = [], []
            for kind, first, told, suffix, evidence, host_n, domain_n, declared_n, suffix_n in zip(*(column[n].to_pylist() for n in ("kind", "first", "declared", "suffix", "evidence", "host_n", "domain_n", "declared_n", "suffix_n")), strict=True):
                belief = prior
                own = np.array([x == first for x in languages], float)  # a row is no evidence about itself
                levels = [suffix_n if suffix else None, domain_n, host_n]
                for n in levels:
                    if n is not None:
                        n = np.maximum(np.asarray(n, float) - own, 0)
                        belief = (n + STRENGTH * belief) / (n.sum() + STRENGTH)
                z = np.log(belief) + np.asarray(evidence) + likelihood(declared_total, told, declared_n)
                if kind == "page":
                    z = z + likelihood(suffix_total, suffix, suffix_n)
                p = np.exp(z - z.max())
                p /= p.sum()
                lang.append(languages[int(p.argmax())])
                probability.append(float(p.max()))
            yield pa.record_batch([column["kind"], column["id"], pa.array(lang), pa.array(probability), column["first"], column["declared"], column["suffix"], column["host"]], ["kind", "id", "lang", "probability", "text_lang", "declared", "suffix", "host"])

    out = joined.mapInArrow(fuse, "kind string, id long, lang string, probability double, text_lang string, declared string, suffix string, host string")
    return out.select("kind", *_ids(), "lang", "probability", "text_lang", "declared", "suffix", "host")


def _ids():
    return F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id")


def _totals(counts: DataFrame, column: str, languages: list[str]) -> np.ndarray:
    """Per language, the counts of all names, and one for each name and one for unknown ones: one row."""
    r = counts.agg(F.count("*"), *(F.sum(F.get(column, F.lit(i))) for i in range(len(languages)))).first()
    return np.array([v or 0.0 for v in r[1:]], float) + r[0] + 1
