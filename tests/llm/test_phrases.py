"""Phrase mining against plain counting, with and without hot words, and texts in stretches."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismlake.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def plain(rows, least, most, top, inside):
    """(lang, rank, phrase, a, l, r, n, score) by loops."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for words in pieces(text):
            for k in range(1, most + 1):
                f[lang or "und"].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if " " not in p)
        found = {p: v for p, v in c.items() if " " in p and v >= least}
        scored = []
        for p, a in found.items():
            w = p.split(" ")
            if any(" " + p + " " in " " + q + " " and q != p and 100 * b >= inside * a for q, b in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.append((-score, -a, p.encode(), c[" ".join(w[:k])], c[" ".join(w[k:])]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(seed, docs=120):
    rng = np.random.default_rng(seed)
    vocabulary = [*"abcdefgh", "Ä", "ä", "x-y", "don't", "\x0b"]
    rows = []
    for i in range(docs):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=[0.3, 0.2, *[0.5 / 11] * 11])
        rows.append(("en" if i % 3 else None, "".join(w + rng.choice([" ", "  ", "\t", ". ", "\n"], p=[0.7, 0.1, 0.1, 0.05, 0.05]) for w in words)))
    return [*rows, ("en", None), ("en", ""), (None, " \t.,"), ("und", "A b a B " * 30), rows[0], rows[0], ("de", "B" * 200)]


@pytest.mark.parametrize(("hot", "most", "top"), [(100_000, 3, 2000), (3, 3, 2000), (60, 4, 7), (1, 2, 50)])
def test_against_plain_counts(spark, monkeypatch, hot, most, top):
    monkeypatch.setattr(phrases, "HOT_COUNT", hot)
    monkeypatch.setattr(phrases, "RANKED", 40)
    rows = corpus(most)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({c: F.lit("q") for c in ("word", "n", "phrase", "rank", "a")})
    got = sorted(tuple(r) for r in phrases.collocations(df, 3, most, top).collect())
    assert got == plain(rows, 3, most, top, 50) and len(got) > 10


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_exact_arithmetic(spark):
    """Products beyond 64 bits: counts of 10**13."""
    row = spark.sql("select 9999999999999L as a, 10000000000000L as l, 10000000000001L as r")
    got = row.select(F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")).first()[0]
    assert got == 1_000_000 * 9999999999999**2 // (10000000000000 * 10000000000001)


@pytest.mark.parametrize("stretch", [1, 7, 40, 1000])
def test_stretches_count_every_word_once(monkeypatch, stretch):
    """A long text cut into stretches gives each word, with its followers, exactly once."""
    monkeypatch.setattr(phrases, "STRETCH", stretch)
    text = " ".join(t or "" for _, t in corpus(9, 30)) + " " + "z" * 50 + " end of it"
    want = Counter()
    for words in pieces(text):
        want.update(tuple(words[i : i + 3]) for i in range(len(words)))
    got = Counter()
    batch = pa.record_batch([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    for _, part, n in phrases.stretches([batch], 3):
        words, piece, _ = phrases.tokens(part)
        w = [x.decode() for x in words.to_pylist()]
        for i in range(len(w) if n is None else n):
            got[tuple(w[j] for j in range(i, min(i + 3, len(w))) if piece[j] == piece[i])] += 1
    assert got == want
