"""Alignment of two tokenizers against loops over tokens, with libraries used directly."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prismlake.llm import alignment, queries

DIR = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b\n\tc"), (5, "Grüße, 😀 and <|endoftext|> <s> </s> <0x41>"), (6, "plain ▁ mark"), (7, "the cat sat on the mat"), (7, "the cat sat on the mat"), (None, "the dog"),
    (8, "　wide ﬁ"), (9, "x" * 3000), (10, "nul\x00here"), (11, "the end of it all " * 300 + "😀 1 2 3"), (12, "trailing "), (13, "the cat"),
]


def plain(rows):
    """The contract's columns by loops over every token and pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(queries.TOKENIZER)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=queries.OTHER_TOKENIZER)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    docs, counts = [], Counter()
    for doc, text in rows:
        a, b = [], []
        if text:
            e = a_side.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(to_byte[c] for c in a_side.id_to_token(i))) for i in e.ids]
            b = [(i, bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()) for i in b_side.encode(text)]
            if any(b"".join(t for _, t in side) != (" " + text).encode() for side in (a, b)):
                a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, k = [], 0
        for i, s, e in spans[0]:
            while k < len(spans[1]) and spans[1][k][2] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][1] < e:
                links.append((i, spans[1][j][0]))
                j += 1
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if last <= s and e <= c) for side in spans))
            last = c
        docs.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        counts.update(set(links))
    top = Counter()
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    return sorted(((d, na, nb, g, len(ln), sum(counts[p] == top[p[0]] for p in ln), sum(counts[p] for p in ln), h) for d, na, nb, g, ln, h in docs), key=repr)


def got(df, **how):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in alignment.align(df, queries.TOKENIZER, queries.OTHER_TOKENIZER, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"most_shared": 5}, {"most_shared": 0, "part": 50, "call": 80}, {"part": 7, "call": 1}])
def test_odd_rows(spark, how):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("row", "key", "keys", "n_a", "docs", "best")})
    want = plain(ODD)
    assert got(df, **how) == want
    assert {1, 2, 6} <= {r[0] for r in want if not r[1]}
    assert got(df.limit(0), **how) == []


def test_table(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    assert got(df) == plain([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
