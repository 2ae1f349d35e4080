"""Phrase collocation mining: contiguous patterns grown from the occurrences of frequent prefixes.

1. Words are counted by language. Those of MIN_COUNT or more are the items; no pattern has another word.
2. Every occurrence of an item is projected: it becomes a pointer that takes along the words after it, up to the
   length of a phrase, the end of its piece or the first word that is no item. A task joins its equal pointers
   of one prefix into one, with their number, and sends a row for each prefix.
3. A task takes the pointers of a prefix and grows it to the right, depth first: the next words that are
   frequent are appended, and each longer prefix goes on with its own pointers.

The prefix that owns a pointer ends with the pointer's first word that isn't hot, so that a prefix has no more
than HOT_COUNT occurrences (or a MOST_HOT-th of all), however common its first words; what is shorter than
its owner is counted in part by several tasks and added up after. A hash filter of the items, of bounded size,
holds words back before the shuffle; words that pass wrongly are rare and fall away when they are counted.

A phrase is scored by the worst of its cuts and kept unless a longer one accounts for half of its occurrences.
A null text is empty, a null language is `und`; repeated rows count each; texts of any length are read in
stretches that overlap by a phrase; no rows, no phrases. Columns other than text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm import bitmaps
from prismlake.llm.lookups import lookup
from prismlake.llm.staging import staged

MIN_COUNT, MAX_WORDS, TOP, INSIDE_PERCENT = 10, 3, 2000, 50
#: A word is hot with more occurrences than HOT_COUNT and than one in MOST_HOT of all words: MOST_HOT words at most are.
HOT_COUNT, MOST_HOT = 100_000, 1_000_000
#: Text that is counted at once, in bytes: the more, the fewer pointers are sent.
STRETCH = 12 << 20
#: Phrases that a task ranks at once, in up to MOST_PARTS parts of which each sends its first ones.
RANKED, MOST_PARTS = 20_000, 256
#: Fixed characters of the contract: between words, and between pieces.
SPACES, CUTS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(CUTS)] = 2


def tokens(text: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Words of lower-cased bytes: the words as a dictionary array, the piece that each stands in, and where each
    starts."""
    kind = _KIND[text]
    word = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text[word]))])
    return words.dictionary_encode(), piece, start


def stretches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[str, np.ndarray, int | None]]:
    """(language, lower-cased bytes, words whose occurrences count; None: all). Texts of a language are put together,
    each a piece of its own at least, up to STRETCH bytes; a longer one is cut between words, and the next stretch
    starts with the words before the cut that had not all their followers."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if not text.is_valid or not (data := text.as_buffer()).size:
                continue
            if data.size > STRETCH:
                yield from _cut(lang, _LOWER[np.frombuffer(data, np.uint8)], words)
                continue
            held.setdefault(lang, []).append(bytes(data))
            size[lang] = size.get(lang, 0) + data.size
            if size[lang] > STRETCH or sum(size.values()) > 2 * STRETCH:
                largest = max(size, key=size.get)
                yield largest, _LOWER[np.frombuffer(b"\n".join(held.pop(largest)), np.uint8)], None
                del size[largest]
    for lang, texts in held.items():
        yield lang, _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)], None


def _cut(lang: str, text: np.ndarray, words: int) -> Iterator[tuple[str, np.ndarray, int | None]]:
    """The stretches of one long text. A window without enough words in it is widened."""
    at, wide = 0, STRETCH
    while len(text) - at > wide:
        between = _KIND[text[at : at + wide]] != 0
        gap = np.flatnonzero(between)
        start = np.flatnonzero(np.diff(np.concatenate([[True], between]).astype(np.int8)) == -1)
        inner = start[start < gap[-1]] if len(gap) else start[:0]
        n = len(inner) - (words - 1)
        if n <= 0:
            wide *= 2
            continue
        yield lang, text[at : at + int(gap[-1])], n
        at, wide = at + int(inner[n] if n < len(inner) else gap[-1]), STRETCH
    yield lang, text[at:], None


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n over texts (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text, n in stretches(batches, 1):
            words, _, _ = tokens(text)
            found = np.bincount(words.indices.to_numpy()[:n], minlength=len(words.dictionary))
            some = np.flatnonzero(found)
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), words.dictionary.take(pa.array(some)).cast(pa.string()), pa.array(found[some])], ["lang", "word", "n"])

    return texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _key(lang: str, word: bytes) -> int:
    """What Spark's xxhash64 gives for the two joined by a tab."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\t" + word, seed=42)


def projections(texts: DataFrame, items: np.ndarray, hot: set[tuple[str, str]], most: int) -> DataFrame:
    """lang, owner, rests, n: pointers of a prefix and how many occurrences each has. rests are the words after the
    owner, joined by a space, one line for each pointer."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((items, {(a, b.encode()) for a, b in hot}))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot_words = shared.value
        for lang, text, count in stretches(batches, most):
            words, piece, _ = tokens(text)
            names = words.dictionary.to_pylist()
            if not names:
                continue
            item = bitmaps.probe(table, np.array([_key(lang, w) for w in names], np.uint64))
            is_hot = np.array([(lang, w) in hot_words for w in names] + [False])
            code = words.indices.to_numpy()
            n = len(code)
            # row k of follow: the k-th word of the pointer, or -1 where it has ended
            follow = np.full((most, n), -1, np.int32)
            follow[0] = np.where(item[code], code, -1)
            for k in range(1, most):
                if n > k:
                    on = (follow[k - 1, : n - k] >= 0) & (piece[k:] == piece[: n - k]) & item[code[k:]]
                    follow[k, : n - k] = np.where(on, code[k:], -1)
            follow = follow[:, : n if count is None else count]
            follow = follow[:, follow[1] >= 0]
            if not follow.shape[1]:
                continue
            base = len(names) + 1
            if base**most < 2**63:
                packed = np.zeros(follow.shape[1], np.int64)
                for row in follow:
                    packed = packed * base + row + 1
                packed.sort()
                first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
                times = np.diff(np.concatenate([first, [len(packed)]]))
                packed = packed[first]
                rows = np.empty((most, len(packed)), np.int32)
                for k in range(most - 1, -1, -1):
                    packed, rest = np.divmod(packed, base)
                    rows[k] = rest - 1
            else:
                rows, times = np.unique(follow, axis=1, return_counts=True)
            length = (rows >= 0).sum(0)
            # the owner ends with the first word that isn't hot, or with the pointer
            owner = np.minimum(np.argmin(np.vstack([is_hot[rows], np.zeros(len(times), bool)]), axis=0) + 1, length)
            head = np.where(np.arange(most)[:, None] < owner, rows, -1)
            new = np.flatnonzero(np.concatenate([[True], (head[:, 1:] != head[:, :-1]).any(0)]))
            yield pa.record_batch(
                [
                    pa.array([lang] * len(new), pa.string()),
                    _joined(words.dictionary, head[:, new]),
                    pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(times)]]), pa.int32()), _joined(words.dictionary, np.where(np.arange(most)[:, None] >= owner, rows, -1))), "\n"),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(times)]]), pa.int32()), pa.array(times, pa.int32())),
                ],
                ["lang", "owner", "rests", "n"],
            )

    return texts.mapInArrow(project, "lang string, owner string, rests string, n array<int>")


def _joined(dictionary: pa.Array, rows: np.ndarray) -> pa.Array:
    """The words of each column joined by spaces; -1 is no word."""
    text = dictionary.cast(pa.string())
    return pc.utf8_trim(pc.binary_join_element_wise(*(text.take(pa.array(row, mask=row < 0)) for row in rows), " ", null_handling="replace", null_replacement=""), " ")


def grown(pointers: DataFrame, hot: set[tuple[str, str]], least: int, most: int) -> DataFrame:
    """lang, phrase, n, whole: frequent phrases of two words or more, and, not whole, what a task has counted of
    those that several owners share."""
    shared = pointers.sparkSession.sparkContext.broadcast(hot)

    def extend(prefix: str, pointers: list[tuple[str, int]]) -> Iterator[tuple[str, int]]:
        """Frequent right extensions of a prefix, each followed by its own."""
        total: dict[str, int] = {}
        for rest, n in pointers:
            word = rest.partition(" ")[0]
            total[word] = total.get(word, 0) + n
        own: dict[str, list[tuple[str, int]]] = {w: [] for w, n in total.items() if n >= least and w}
        if not own:
            return
        for rest, n in pointers:
            word, _, more = rest.partition(" ")
            if more and word in own:
                own[word].append((more, n))
        for word, more in own.items():
            yield f"{prefix} {word}", total[word]
            yield from extend(f"{prefix} {word}", more)

    def grow_one(lang: str, owner: str, total: int, rests: list[str], counts: list[np.ndarray], partial: dict) -> Iterator[tuple[str, int]]:
        words = owner.split(" ")
        for k in range(2, len(words)):  # all hot: owners with other words after them add to these
            partial[lang, " ".join(words[:k])] = partial.get((lang, " ".join(words[:k])), 0) + total
        if len(words) > 1:
            if (lang, words[-1]) in shared.value and len(words) < most:
                partial[lang, owner] = partial.get((lang, owner), 0) + total
            elif total >= least:
                yield owner, total
        if total >= least and len(words) < most:
            yield from extend(owner, [p for text, n in zip(rests, counts, strict=True) for p in zip(text.split("\n"), n.tolist(), strict=True)])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple[str, str], int] = {}
        out: list[tuple[str, str, int, bool]] = []
        # the last prefix of a batch may go on in the next one
        now: tuple[str, str] | None = None
        total, rests, counts = 0, [], []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], ["lang", "phrase", "n", "whole"])

        def close() -> None:
            if now is not None:
                out.extend((now[0], p, n, True) for p, n in grow_one(*now, total, rests, counts, partial))

        for b in batches:
            if not b.num_rows:
                continue
            lang, owner, rest = b.column(0), b.column(1), b.column(2)
            values, at = b.column(3).values.to_numpy(), b.column(3).offsets.to_numpy()
            sums = np.add.reduceat(values[: at[-1]], at[:-1], dtype=np.int64)
            new = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(owner[1:], owner[:-1])).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.concatenate([[True], new]))
            size = np.add.reduceat(sums, start)
            single = pc.equal(pc.find_substring(owner, " "), -1).to_numpy(zero_copy_only=False)[start]
            for i, (a, z) in enumerate(zip(start.tolist(), [*start[1:].tolist(), b.num_rows], strict=True)):
                if 0 < i < len(start) - 1 and single[i] and size[i] < least:
                    continue  # a whole prefix of one word with fewer occurrences than a pattern needs
                key = (lang[a].as_py(), owner[a].as_py())
                if key != now:
                    close()
                    now, total, rests, counts = key, 0, [], []
                total += int(size[i])
                rests += rest[a:z].to_pylist()
                counts += [values[at[k] : at[k + 1]] for k in range(a, z)]
            if len(partial) > 100_000:
                out += [(*k, n, False) for k, n in partial.items()]
                partial.clear()
            if len(out) > 10_000:
                yield batch(out)
                out = []
        close()
        out += [(*k, n, False) for k, n in partial.items()]
        if out:
            yield batch(out)

    sent = pointers.repartition("lang", "owner").sortWithinPartitions("lang", "owner")
    return sent.mapInArrow(grow, "lang string, phrase string, n long, whole boolean")


def frequent_phrases(documents: DataFrame, least: int = MIN_COUNT, most: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, totals, phrases): lang, phrase, n for the frequent words, lang, n for all words, and lang, phrase, n for
    the frequent phrases of 2 to `most` words."""
    if least < 1 or most < 2:
        raise ValueError("phrases have two words or more and occur once or more")
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    every = staged(word_counts(texts), "phrase-words")
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    words = every.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n")
    all_words = every.agg(F.sum("n")).first()[0] or 0
    hot = {(r["lang"], r["phrase"]) for r in words.where(F.col("n") > max(HOT_COUNT, all_words / MOST_HOT)).collect()}
    items = bitmaps.build(words.select(F.xxhash64(F.concat("lang", F.lit("\t"), "phrase")).alias("key")), "key")
    counted = staged(grown(projections(texts, items, hot, most), hot, least, most), "phrase-counts")
    shared = counted.where("not whole").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, totals, counted.where("whole").select("lang", "phrase", "n").unionAll(shared)


def collocations(documents: DataFrame, least: int = MIN_COUNT, most: int = MAX_WORDS, top: int = TOP, inside: int = INSIDE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases.

    score is floor(1000000 * a * a / (l * r)) for the cut that makes it least, the earliest of equal ones; l and r
    count the parts. A phrase inside a longer frequent one with `inside` percent or more of its occurrences is
    left out. Products are decimals of 38 digits: exact."""
    words, totals, found = frequent_phrases(documents, least, most)
    phrases = staged(found, "phrase-found")
    counts = words.unionAll(phrases)
    size = F.size(F.split("phrase", " "))
    cuts = staged(
        phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
        .select("lang", "phrase", "a", "k", F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.lit(most)), " ").alias("rest")), "phrase-cuts"
    )
    left = staged(lookup(cuts, counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]), "phrase-left")
    both = lookup(left, counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    exact = both.withColumn("score", F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"))
    scored = exact.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    longer = phrases.where(size > 2).select("lang", "n", size.alias("words"), "phrase").select("lang", "n", "phrase", F.explode(F.expr("flatten(transform(sequence(2, words - 1), w -> transform(sequence(0, words - w), s -> named_struct('s', s, 'w', w))))")).alias("p"))
    inner = longer.select("lang", F.array_join(F.slice(F.split("phrase", " "), F.col("p.s") + 1, F.col("p.w")), " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a"))).drop("longest")
    return ranked(kept, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language, with rank. Parts of a language are ranked first, so no task orders it all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    stored = staged(scored, "phrase-scores")
    parts = min(stored.count() // RANKED + 1, MOST_PARTS)
    some = stored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    few = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
