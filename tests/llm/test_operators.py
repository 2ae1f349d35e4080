"""The operators against plain versions, on small fixtures and on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismlake.llm import boosting, chat, decontaminate, language, line_quality, neardup, packing, pii, quality_rules, queries, staging, substring, url_filter
from prismlake.llm.staging import components

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def words(n, seed, of=5000):
    return " ".join(f"w{v}" for v in np.random.default_rng(seed).integers(0, of, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, white space, long, ties, repeated rows, and extra columns with clashing names."""
    long = words(30000, 1)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "a b"), (6, "a b"), (None, "some text of no id"), (7, "Grüße + 1 @ ..")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "row", "score", "kept", "bands", "h", "rank", "label")})


def test_odd_rows_everywhere(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, words(40, 9))], "item_id long, text string")
    for documents, n in ((odd, 9), (odd.limit(0), 0)):
        assert quality_rules.fit(documents, labels) is None
        assert quality_rules.score_documents(documents, None).count() == n
        assert quality_rules.keep_good(documents, None).columns == odd.columns
        got = neardup.classes(documents).collect()
        assert len(got) == n
        assert neardup.keep_one(documents).count() == (8 if n else 0)
        got = {r["doc_id"]: r for r in substring.repeated_passages(documents).collect()}
        assert not n or (got[5]["class_id"] == 4 and got[4]["passages"] == "0:30000" and got[6]["passages"] == "")
        assert decontaminate.contaminated(documents, items.limit(0)).count() == 0
        found = decontaminate.contaminated(documents, items).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == ({(6, 3)} if n else set())
        field = pii.fit(documents)
        assert pii.find(documents, field).count() == n
        assert pii.mask(documents, field).columns == odd.columns
        packed = packing.pack(documents, queries.TOKENIZER)
        assert packed.select("doc_id").distinct().count() == (8 if n else 0)
        assert line_quality.fit(documents, labels) is None
        assert line_quality.score_documents(documents, None).count() == n


def _statistics(text):
    ws = WORD.findall(text or "")
    runs = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    inside = {k for i in range(len(ws) - 7) if runs[tuple(ws[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside)


def test_quality_rules(spark):
    documents = spark.read.parquet(f"{DIR}/documents.parquet")
    got = queries.op2_quality_rules(spark, DIR).toPandas().set_index("doc_id")
    for r in documents.collect():
        n, *rest = _statistics(r["text"])
        g = got.loc[r["doc_id"]]
        assert (g["n_words"], *(g[k] for k in quality_rules.BASE_COUNTS[1:])) == (n, *rest)
        assert g["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n)
    joined = got.join(spark.read.parquet(f"{DIR}/labels.parquet").toPandas().set_index("doc_id"), how="inner")
    assert (joined["kept"] == (joined["quality"] == 1)).mean() > 0.95


def test_boosting_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + 0.5 * rng.normal(size=800) > 0).astype(float)
    forest = boosting.fit(x, y, np.array([1, 0, -1]))
    grid = np.tile(rng.normal(size=(50, 1, 3)), (1, 40, 1))
    for j, sign in ((0, 1), (2, -1)):
        g = grid.copy()
        g[:, :, j] = np.linspace(-3, 3, 40)
        m = forest.margin(g.reshape(-1, 3)).reshape(50, 40)
        assert (sign * np.diff(m, axis=1) >= -1e-12).all()
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.85


def _bags(texts):
    out = {}
    for k, t in texts.items():
        w = WORD.findall(t.lower())
        out[k] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    return out


def _brute_classes(texts, threshold=0.8):
    bags = _bags(texts)
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where = defaultdict(list)
    for k, b in bags.items():
        for s in b:
            where[s].append(k)
    for a, b in {(a, b) for v in where.values() for a in v for b in v if a < b}:
        shared = sum((bags[a] & bags[b]).values())
        if shared >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}


def test_near_duplicates(spark):
    documents = spark.read.parquet(f"{DIR}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in queries.op4_minhash_dedup(spark, DIR).collect()}
    assert got == _brute_classes({r["doc_id"]: r["text"] for r in documents.collect()})


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    key = np.concatenate([h, h])
    v = neardup.signatures(key, np.repeat([0, 1], 300), np.concatenate([a, b]), 2, 4000)
    assert (v[0] == v[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)}


def test_compact_windows_cover_all_minima():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, 120).astype(np.uint64)
    first = np.array([0, 50, 50, 53, 120])
    row, left, centre, right = substring.compact_windows(values, first, 6)
    for r in range(4):
        for i in range(first[r], first[r + 1] - 5):
            least = values[i : i + 6].min()
            on = [k for k in range(len(row)) if row[k] == r and left[k] <= i and right[k] >= i + 5 and values[centre[k]] == least]
            assert len(on) == 1
    assert (values[centre] == [values[a : b + 1].min() for a, b in zip(left, right, strict=True)]).all()


def test_passages(spark):
    shared, edited = words(80, 70), words(120, 71).split()
    changed = edited.copy()
    changed[60] = "other"
    texts = [words(200, 1) + " " + shared + " " + words(90, 2), words(30, 3) + " " + shared, words(300, 4), " ".join(edited) + " " + words(50, 5), words(40, 6) + " " + " ".join(changed), words(60, 7) + " " + words(20, 70), words(100, 8)]
    got = {r["doc_id"]: r for r in substring.repeated_passages(frame(spark, texts)).collect()}
    assert got[0]["passages"] == "200:280" and got[1]["passages"] == "30:110" and got[1]["class_id"] == 0
    assert got[3]["class_id"] == got[4]["class_id"] == 3 and got[4]["n_repeated_words"] >= 100
    assert all(got[k]["passages"] == "" and got[k]["class_id"] == k for k in (2, 5, 6))


def test_passages_of_the_tables(spark):
    """Against a comparison of all pairs of texts that share 37 shingles, the fewest that a passage of 46 can
    share at 0.8: the same documents, the same classes, and nearly the same words."""
    rows = {r["doc_id"]: WORD.findall((r["text"] or "").lower()) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    h = {k: np.array([hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)], np.int64) for k, w in rows.items()}
    where = defaultdict(list)
    for k, v in h.items():
        for x in set(v.tolist()):
            where[x].append(k)
    shared = Counter((a, b) for v in where.values() for a in v for b in v if a < b)
    covered = {k: np.zeros(len(w), bool) for k, w in rows.items()}
    parent = {k: k for k in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, b), n in shared.items():
        copies = rows[a] == rows[b] and len(rows[a]) >= 50
        found = [(0, len(h[a]), 0, len(h[b]))] if copies else substring.aligned(h[a], h[b], 46, 0.8) if n >= 37 else []
        for p, q, r, t in found:
            covered[a][p : q + 4] = covered[b][r : t + 4] = True
        if found:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in queries.op3_repeated_passages(spark, DIR).collect()}
    assert {k for k, r in got.items() if r["n_repeated_words"]} == {k for k, c in covered.items() if c.any()}
    assert {k: r["class_id"] for k, r in got.items()} == {k: root(k) for k in rows}
    reached = 0
    for k, r in got.items():
        spans = [tuple(map(int, p.split(":"))) for p in r["passages"].split(",") if p]
        assert all(covered[k][a:b].all() for a, b in spans)
        reached += sum(b - a for a, b in spans)
    assert reached >= 0.98 * sum(c.sum() for c in covered.values())


def test_decontamination(spark):
    items = {1: words(30, 50), 2: words(14, 51), 3: "only three words"}
    cut = items[1].split()
    texts = [words(900, 1) + " " + items[1] + " " + words(30, 2), words(20, 3) + " " + items[2].upper(), " ".join(cut[:27]), " ".join(cut[:15]) + words(50, 4), "here are only three words more"]
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, texts), table).collect()}
    assert got == {(0, 1), (1, 2), (2, 1), (4, 3)}


def test_cut_windows_are_the_sliding_minima():
    rng = np.random.default_rng(0)
    for least in (2, 5, 8):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 30, 6))])
        v = rng.integers(0, 40, first[-1]).astype(np.uint64)
        row, left, right, key = substring.cut_windows(v, first, least)
        got = [(a, p, d) for a, b, c, d in zip(row, left, right, key, strict=True) for p in range(b, c - least + 2)]
        assert sorted(got) == sorted((i, p, v[p : p + least].min()) for i in range(6) for p in range(first[i], first[i + 1] - least + 1))


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.TOKENIZER)
    t.encode_special_tokens = True
    documents = spark.read.parquet(f"{DIR}/documents.parquet").unionByName(frame(spark, [None, "", "a <|endoftext|> b 漢字 \u00a0\n\n  x", "'s 12345 é" * 400], [9001, 9002, 9003, 9004]))
    packed = packing.pack(documents, queries.TOKENIZER, keep_ids=True).toPandas()
    by = packed.sort_values("piece").groupby("doc_id")
    for r in documents.collect():
        ids = np.append(t.encode(r["text"] or "", add_special_tokens=False).ids, 2).astype("<u4")
        g = by.get_group(r["doc_id"])
        assert (np.concatenate(list(g["ids"])) == ids).all()
        assert list(g["start"]) == list(np.cumsum(g["length"]) - g["length"]) and (g["length"].iloc[1:] == 1024).all() and g["length"].max() <= 1024
        assert list(g["ids_crc32"]) == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(g["start"], g["length"], strict=True)]
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == list(np.cumsum(g["length"]) - g["length"]) and g["length"].sum() <= 1024
    assert packed["sequence_id"].nunique() <= -(-packed["length"].sum() // 1024) * 1.02 + 1
    rows = packing.sequences(packing.pack(documents.limit(20), queries.TOKENIZER, keep_ids=True)).collect()
    assert all(len(r["ids"]) <= 1024 and len(r["doc_ids"]) == len(r["offsets"]) for r in rows)


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_packing_holds_every_capacity(select):
    rng = np.random.default_rng(4)
    counts = Counter(rng.integers(1, 400, 3000).tolist())
    plan = packing.Plan(counts, (1000, 6, 300_000), select=select)
    used = defaultdict(lambda: np.zeros(3, int))
    ranks = defaultdict(set)
    for length, a, b, first, _ in plan.rows:
        for k in range(a, b):
            assert k not in ranks[length]
            ranks[length].add(k)
            used[first + k - a] += (length, 1, length * length)
    assert {k: len(v) for k, v in ranks.items()} == counts
    assert all((v <= (1000, 6, 300_000)).all() for v in used.values()) and len(used) == plan.sequences


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_turn|>", "a\\", "\\\\<|", "", None, "<|im_turn|>\n<|im_start|>assistant\n", "née 漢\n"]
    rows = [(1, i, ("user", "assistant", "assistant", "system")[i % 4], t) for i, t in enumerate(nasty)] + [(2, 0, None, "x"), (2, 0, None, "x"), (None, 1, "assistant", "y"), (3, 1, "odd role|>\n", "z")]
    rows += [(4, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(500)]
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("turns", F.lit(1)))
    got = {r["conv_id"]: r for r in chat.read_back(f).collect()}
    digests = {r["conv_id"]: r for r in chat.digests(f).collect()}
    for k in (1, 2, None, 3, 4):
        want = [(r or "", t or "") for c, _, r, t in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert [tuple(t) for t in got[k]["turns"]] == want
        learned = [t for r, t in want if r == "assistant"]
        assert list(got[k]["loss_texts"]) == learned
        assert digests[k]["n_turns"] == len(want) and digests[k]["loss_sha256"] == hashlib.sha256("".join(learned).encode()).hexdigest()
        assert digests[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()


def test_chat_of_many_turns(spark):
    n = 30000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<|"), F.col("id")).alias("text"))
    d = chat.digests(chat.format_conversations(turns)).first()
    texts = [f"t<|{i}" for i in range(n) if i % 3]
    assert d["n_turns"] == n and d["loss_sha256"] == hashlib.sha256("".join(texts).encode()).hexdigest() and d["loss_chars"] == sum(map(len, texts))
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0


def test_urls(spark):
    urls = {
        1: "https://A.Example.NET/en/x?q#f", 2: "http://x.net/de", 3: "http://example.com/de/1", 4: "http://sub.example.com/de/", 5: "http://a.org/fr/1", 6: "http://a.org/en", 7: None, 8: "no scheme", 9: "http://net/",
        10: "http://examplenet/en/", 11: "http://x.net", 12: "ÄB://ÜX.net/?a://b", 13: "http://example.com?/de/",
    }
    rows = list(urls.items()) + [(100 + i, f"http://m.casino-win.example.com/en/{i}") for i in range(40)] + [(200 + i, f"http://site{i}.example.com/en/{i}") for i in range(200)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))).collect()}
    assert len(got) == len(rows)
    want = {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("example.com/de/", "block"), 4: ("example.com/de/", "block"), 5: ("org/fr/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("net/", "block"), 10: (None, "allow"), 11: (None, "allow"), 12: ("net/", "block"), 13: (None, "allow")}
    assert {k: (got[k]["rule"], got[k]["verdict"]) for k in want} == want
    assert (got[1]["host"], got[1]["path"]) == ("a.example.net", "/en/x") and (got[12]["host"], got[12]["path"]) == ("Üx.net", "/") and got[13]["path"] == ""
    assert all(got[100 + i]["verdict"] == "block" for i in range(40)) and all(got[200 + i]["verdict"] == "allow" for i in range(200))
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _plain_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and pii._luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def test_base_patterns(spark):
    rng = np.random.default_rng(8)
    alphabet = list("0123456789999....--  ++()@@ab.c%_é\n")
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert pii.base_spans(text) == _plain_spans(text), text
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        assert pii.base_spans(r["text"]) == _plain_spans(r["text"])


def test_personal_data(spark):
    got = queries.op6_personal_data(spark, DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in got:
        base = _plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["n_email"] == sum(k == "email" for k, *_ in base)
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))
    one = frame(spark, ["write to a.b@mail.example.com or +1 (555) 123-4567 now", "nothing here"])
    assert [r["text"] for r in pii.mask(one, None).orderBy("doc_id").collect()] == ["write to <email> or <phone> now", "nothing here"]


def test_message_passing_is_exact_on_a_tree():
    rng = np.random.default_rng(3)
    field = pii.Field(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(2, 5, 5)))
    g = pii.Graph()
    g.row, g.features, g.edges = [0] * 4, [[0, 1], [2], [3, 4], [5]], [(0, 1, 0), (1, 2, 1), (1, 3, 0)]
    p = field.marginals(g, 200)
    local = np.array([field.unary[f].sum(0) for f in g.features])
    joint = np.zeros((5,) * 4)
    for at in np.ndindex(joint.shape):
        joint[at] = np.exp(sum(local[i, k] for i, k in enumerate(at)) + sum(field.pair[t, at[i], at[j]] for i, j, t in g.edges))
    joint /= joint.sum()
    for i in range(4):
        np.testing.assert_allclose(p[i], joint.sum(tuple(k for k in range(4) if k != i)), atol=1e-3)


def test_line_field_marginals():
    rng = np.random.default_rng(1)
    field = line_quality.LineField([], np.zeros(1), rng.normal(size=(2, 2)))
    odds, row = rng.normal(size=6), np.array([0, 0, 0, 0, 1, 1])
    p, _ = field.marginals(odds, row, 2)
    joint = np.zeros((2,) * 4)
    for at in np.ndindex(joint.shape):
        joint[at] = np.exp(sum(odds[i] * k for i, k in enumerate(at)) + sum(field.pair[at[i], at[i + 1]] for i in range(3)))
    for i in range(4):
        assert p[i] == pytest.approx(joint.sum(tuple(k for k in range(4) if k != i))[1] / joint.sum())


def test_line_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op10_line_quality(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held["doc_id"]]).all()
    assert (held["predicted"] == held["quality"]).mean() > 0.9


def test_language(spark):
    got = queries.op9_language(spark, DIR).toPandas()
    documents = got[got["kind"] == "document"].merge(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", F.col("lang").alias("told")).toPandas(), on="doc_id")
    pages = got[got["kind"] == "page"]
    assert len(documents) == 200 and len(pages) == 50
    assert (documents["lang"] == documents["told"]).mean() > 0.97 and (pages["lang"] == pages["declared"]).mean() > 0.97
    assert language.plain_text("<p>a<script>var t='</p>';</script><b>b</b><!-- x -->") == "a b"


def test_pipeline(spark):
    import corpus_pipeline

    documents = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {r["doc_id"] for r in queries.op2_quality_rules(spark, DIR).where("kept").select("doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect() if r["doc_id"] in kept}
    classes = _brute_classes(texts)
    texts = {k: t for k, t in texts.items() if classes[k] == k}
    items = {r["item_id"]: set(_bags({0: r["text"]})[0]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    bags = _bags(texts)
    want = {k for k in texts if not any(len(q & bags[k].keys()) >= 0.8 * len(q) for q in items.values())}
    packed = corpus_pipeline.run(spark, DIR).toPandas()
    assert set(packed["doc_id"]) == want
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def _brute_passages(x, y, least, t):
    """Places of x in any passage that begins and ends with the same shingles as one of y."""
    inside = np.zeros(len(x), bool)
    for a in range(len(x)):
        for c in np.flatnonzero(y == x[a]):
            for b in range(a + least, len(x) + 1):
                for d in np.flatnonzero(y == x[b - 1]) + 1:
                    if d - c >= least:
                        p, q = set(x[a:b].tolist()), set(y[c:d].tolist())
                        if len(p & q) >= t * len(p | q) - 1e-9:
                            inside[a:b] = True
    return inside


@pytest.mark.parametrize("words, edits", [(55, [27]), (60, [30]), (84, [42]), (84, [20, 60]), (200, [40, 80, 120, 160])])
@pytest.mark.parametrize("insert", [False, True])
def test_passages_with_edits(words, edits, insert):
    rng = np.random.default_rng(words)
    one = rng.integers(0, 10**9, words).tolist()
    two = list(one)
    for e in reversed(edits):
        two[e : e + (not insert)] = [-e]
    noise = lambda: rng.integers(10**9, 2 * 10**9, 20).tolist()
    x, y = (np.array([hash(tuple(v[i : i + 5])) for i in range(len(v) - 4)]) for v in (noise() + one + noise(), noise() + two + noise()))
    got = np.zeros(len(x), bool)
    for a, b, c, d in substring.aligned(x, y, 46, 0.8):
        p, q = set(x[a:b].tolist()), set(y[c:d].tolist())
        assert min(b - a, d - c) >= 46 and len(p & q) >= 0.8 * len(p | q) - 1e-9
        got[a:b] = True
    assert got.tolist() == _brute_passages(x, y, 46, 0.8).tolist()
    if not insert and edits != [27]:
        assert got.sum() >= words - 4


def test_regions_meet_whatever_their_order():
    import pyarrow as pa

    w = [{"al": 0, "ar": 60, "bl": 0, "br": 60, "k": 1}, {"al": 5, "ar": 140, "bl": 5, "br": 140, "k": 0}, {"al": 1, "ar": 50, "bl": 90, "br": 140, "k": 1}]
    batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([1]), pa.array([2]), pa.array([w])], ["a", "b", "part", "its_part", "w"])
    assert [r["regions"] for b in substring._overlaps(iter([batch]), 2, 46) for r in b.to_pylist()] == [[{"al": 0, "ar": 140, "bl": 0, "br": 140}]]


def test_passages_with_every_other_text(spark):
    # all quote 60 words, and two of them the 35 that follow as well
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 10**9, n)]
    anchor, own = words(60), words(35)
    texts = [words(40) + anchor + words(40) for _ in range(6)] + [words(40) + anchor + own + words(40) for _ in range(2)]
    got = {r["doc_id"]: r for r in substring.repeated_passages(frame(spark, [" ".join(t) for t in texts])).collect()}
    assert {k: (r["passages"], r["n_links"]) for k, r in got.items()} == {k: ("40:100" if k < 6 else "40:135", 7) for k in range(8)}


def test_passages_link_texts_directly(spark):
    # 1 has a passage in common with 0 and another with 2 and 3; 4 copies 0; 2 and 3 have one more, edited
    p, q, r = (words(60, k) for k in (80, 81, 82))
    edited = r.split()
    edited[30] = "other"
    texts = [f"{words(40, 1)} {p}", f"{p} {words(70, 2)} {q}", f"{q} {words(30, 3)} {r}", f"{words(20, 4)} {' '.join(edited)} {words(70, 5)} {q}", f"{words(40, 1)} {p}", words(90, 6)]
    got = {k["doc_id"]: k for k in substring.repeated_passages(frame(spark, texts)).collect()}
    assert [got[k]["n_links"] for k in range(6)] == [2, 3, 2, 2, 2, 0]
    assert [got[k]["class_id"] for k in range(6)] == [0, 0, 0, 0, 0, 5]
    assert [got[k]["passages"] for k in range(6)] == ["0:100", "0:60,130:190", "0:60,90:150", "20:80,150:210", "0:100", ""]


def test_links_of_the_tables(spark):
    """n_links and passages against a comparison of all pairs of texts that share 37 shingles."""
    rows = {r["doc_id"]: " ".join(WORD.findall((r["text"] or "").lower())) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    copies = Counter((r["text"] or "").lower() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect())
    own = {r["doc_id"]: (r["text"] or "").lower() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    one = {t: k for k, t in own.items()}
    h = {k: np.array([hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)], np.int64) for k, w in ((k, rows[k].split()) for k in one.values())}
    where = defaultdict(list)
    for k, v in h.items():
        for x in set(v.tolist()):
            where[x].append(k)
    n, covered = Counter(), {k: np.zeros(len(v) + 4, bool) for k, v in h.items()}
    for (a, b), shared in Counter((a, b) for v in where.values() for a in v for b in v if a < b).items():
        found = substring.aligned(h[a], h[b], 46, 0.8) if shared >= 37 else []
        for p, q, r, t in found:
            covered[a][p : q + 4] = covered[b][r : t + 4] = True
        n.update([a, b] if found else [])
    for r in queries.op3_repeated_passages(spark, DIR).collect():
        k = one[own[r["doc_id"]]]
        copied = r["n_words"] >= 50 and copies[own[k]] > 1
        assert r["n_links"] == n[k] + copied
        assert r["n_repeated_words"] == (r["n_words"] if copied else covered[k].sum())


def test_common_runs_in_order():
    rng = np.random.default_rng(5)
    for _ in range(60):
        x = rng.permutation(400)[: rng.integers(60, 300)]
        y = np.delete(x, rng.integers(0, len(x), rng.integers(0, 5)))
        y = np.insert(y, np.sort(rng.integers(0, len(y), 4)), 1000 + np.arange(4))
        quick = substring.aligned(x, y, 46, 0.8)
        most, substring.MOST_RUNS = substring.MOST_RUNS, 0
        try:
            assert substring.aligned(x, y, 46, 0.8) == quick
        finally:
            substring.MOST_RUNS = most


def _periodic(rng, units):
    """Some of the units, each a few times."""
    return np.concatenate([np.tile(units[k], rng.integers(1, 40))[: rng.integers(20, 120)] for k in rng.integers(0, len(units), rng.integers(1, 5))])


def test_outer_begins_are_enough():
    # texts that repeat themselves: the same passages as from all begins and ends of common runs
    rng = np.random.default_rng(11)
    found = 0
    for _ in range(150):
        units = [rng.integers(0, 400, rng.choice([1, 2, 7, 30, 60])) for _ in range(3)]
        x, y = _periodic(rng, units), _periodic(rng, units)
        quick = substring.aligned(x, y, 46, 0.8)
        few, substring.FEW_RUNS = substring.FEW_RUNS, 10**9
        try:
            assert substring.aligned(x, y, 46, 0.8) == quick
        finally:
            substring.FEW_RUNS = few
        found += bool(quick)
    assert found > 20
    x = np.tile(np.arange(7), 60)
    a, c, _, _ = substring._corners(x, x)
    assert substring._outermost(x, x, a, c, 46).sum() == 1


def test_blocks_are_compared_as_pairs(monkeypatch):
    """All zones of two blocks at once, against one pair after another, by slices of any size."""
    rng = np.random.default_rng(12)
    base = [rng.permutation(100_000)[:300] for _ in range(3)]
    zones = []
    for k in range(40):
        v = base[k % 3][rng.integers(0, 60) : rng.integers(160, 300)].copy()
        v[rng.integers(0, len(v), rng.integers(0, 12))] = 200_000 + rng.integers(0, 10**6)
        zones.append(np.concatenate([v, v[:30]]) if k % 7 == 0 else v[::-1] if k % 11 == 0 else v)
    number = np.concatenate(zones)
    kinds = np.unique(number)
    common = np.array([sum(v in z for z in map(set, zones)) > 1 for v in kinds])
    h = [np.array([(int(v) << 1) | int(common[np.searchsorted(kinds, v)]) for v in z], np.int64) for z in zones]
    before = [substring._before(z) for z in zones]
    ids = np.arange(40)
    for alone in (True, False):
        left = np.full(40, True) if alone else ids % 2 == 0
        table = pa.table({"left": left, "zone": ids, "low": ids, "high": ids + (ids == 5), "plain": [bool((b < 0).all()) for b in before], "fewest": pa.array([substring._fewest(b, 46) for b in before], pa.int32()), "h": pa.array([v.tolist() for v in h], pa.list_(pa.int64()))})
        want = {}
        for i in range(40):
            for j in range(i, 40) if alone else range(40):
                if (i != j or i == 5) if alone else left[i] and not left[j]:
                    x, y = (np.where(v & 1, v, v + n * 10**8) for v, n in ((h[i], 2), (h[j], 4)))
                    if p := substring.aligned(x, y, 46, 0.8):
                        want[i, j] = sorted(p)
        for passages, pairs in ((1 << 16, 1 << 19), (3, 500)):
            monkeypatch.setattr(substring, "SLICE_PASSAGES", passages)
            monkeypatch.setattr(substring, "SLICE_PAIRS", pairs)
            rows = [r for b in substring._compare(table, alone, 46, 0.8) for r in b.to_pylist()]
            assert {(r["a"], r["b"]): sorted(tuple(p.values()) for p in r["passages"]) for r in rows} == want and len(rows) == len(want)
        assert len(want) > 50


def test_zones_go_where_they_have_runs(spark, monkeypatch):
    """Any two zones with a run of 17 in common meet; none goes to a block with which it has nothing in common."""
    monkeypatch.setattr(substring, "BLOCK_PLACES", 500)
    places = substring.places_of(substring.candidates(spark.read.parquet(f"{DIR}/documents.parquet")), 5)
    zones = substring.zones(places, 46, 0.8).groupBy("zone").agg(F.first("h").alias("h"))
    h = {r["zone"]: r["h"] for r in zones.collect()}
    runs = {k: {tuple(v[i : i + 17]) for i in range(len(v) - 16) if all(s & 1 for s in v[i : i + 17])} for k, v in h.items()}
    sent = substring.blocks(zones, 17).collect()
    sides, of = defaultdict(lambda: (set(), set())), {}
    for r in sent:
        sides[r["b"], r["c"]][not r["left"]].add(r["zone"])
        if r["b"] == r["c"]:
            of[r["zone"]] = r["b"]
    assert len(set(of.values())) > 3 and len(sent) == len({tuple(r) for r in sent})
    owner = defaultdict(set)
    for k, own in runs.items():
        for run in own:
            owner[run].add(k)
    for x, y in {(x, y) for own in owner.values() for x in own for y in own if of[x] < of[y]}:
        assert x in sides[of[x], of[y]][0] and y in sides[of[x], of[y]][1]
    shingles = {k: {s for s in v if s & 1} for k, v in h.items()}
    for (b, c), (left, right) in sides.items():
        if b != c:
            assert all(any(shingles[x] & shingles[y] for y in right) for x in left) and all(any(shingles[x] & shingles[y] for x in left) for y in right)


def test_links_are_handed_on_by_zone(spark, monkeypatch):
    """A row for a zone in a pair of blocks, not one for each link, and no zone is sent anywhere."""
    rng = np.random.default_rng(14)
    bases = [words(120, 90 + k).split() for k in range(2)]
    texts = []
    for k in range(40):
        parts = []
        for base in bases[: 1 + k % 2]:
            own = list(base)
            own[rng.integers(5, 115)] = f"own{k}"
            parts.append(" ".join(own))
        texts.append(f" {words(30, 200 + k)} ".join(parts))
    seen = {}

    def kept(df, name, *a):
        seen[name] = staging.staged(df, name, *a)
        return seen[name]

    monkeypatch.setattr(substring, "staged", kept)
    got = {r["doc_id"]: r for r in substring.repeated_passages(frame(spark, texts)).collect()}
    assert {r["n_links"] for r in got.values()} == {39} and {r["class_id"] for r in got.values()} == {0}
    rows = seen["found"].collect()
    assert "places" in seen["found"].columns and len(rows) <= 2 * len({r["zone"] for r in rows}) <= 160


def test_summed_links_are_all_links():
    """Places of each text and its linked texts, from sums by zone, against the links one by one."""
    rng = np.random.default_rng(15)
    for _ in range(20):
        texts = {t: sorted(set(rng.integers(0, 12, rng.integers(1, 4)).tolist())) for t in range(100, 100 + rng.integers(8, 20))}
        kind = {t: z[0] if len(z) == 1 else 1000 + min(u for u in texts if texts[u] == z) for t, z in texts.items()}
        having = {z: [t for t in texts if z in texts[t]] for z in range(12)}
        ids = [z for z in range(12) if having[z]]
        kinds = [[{"kind": k, "n": n} for k, n in Counter(kind.values()).items() if k in {kind[t] for t in having[z]}] for z in ids]
        table = pa.table({"zone": ids, "low": [min(having[z]) for z in ids], "high": [max(having[z]) for z in ids], "kinds": pa.array(kinds, pa.list_(pa.struct([("kind", pa.int64()), ("n", pa.int64())])))})
        links = [(a, b) for a in ids for b in ids if a <= b and len({*having[a], *having[b]}) > 1 and rng.random() < 0.4 and (a != b or len(having[a]) > 1)]
        if not links:
            continue
        passages = [[dict(zip(("a_start", "a_end", "b_start", "b_end"), (s := rng.integers(0, 30), s + rng.integers(5, 20), u := rng.integers(0, 30), u + rng.integers(5, 20)), strict=True)) for _ in range(rng.integers(1, 3))] for _ in links]
        covered, linked = defaultdict(set), {t: set() for t in texts}
        for (a, b), own in zip(links, passages, strict=True):
            for p in own:
                for x, y, s, e in ((a, b, p["a_start"], p["a_end"]), (b, a, p["b_start"], p["b_end"])):
                    for t in having[x]:
                        if set(having[y]) - {t}:
                            covered[t, x].update(range(s, e))
            for x, y in ((a, b), (b, a)):
                for t in having[x]:
                    linked[t].update(having[y])
        found = []
        for part in np.array_split(np.arange(len(links)), 3):
            if len(part):
                batch = pa.record_batch([pa.array([links[k][0] for k in part]), pa.array([links[k][1] for k in part]), pa.array([False] * len(part)), pa.array([passages[k] for k in part], pa.list_(pa.struct([(n, pa.int32()) for n in ("a_start", "a_end", "b_start", "b_end")])))], ["a", "b", "tree", "passages"])
                found += substring.Zones(table).summed(batch).to_pylist()
        for t, own in texts.items():
            n, sets = 0, {}
            for r in found:
                if r["zone"] in own:
                    n += r["n"]
                    sets |= dict(zip(r["kinds"], r["ns"], strict=True))
            assert n + sum(sets.values()) - (kind[t] in sets) == len(linked[t] - {t})
            for z in own:
                assert covered[t, z] == {k for r in found if r["zone"] == z and r["only"] != t for p in r["places"] for k in range(p["s"], p["e"])}


def test_shuffles_are_dropped(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with staging.shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before


def test_language_drops_no_name(spark):
    assert language.declared_language("<!-- " + "x" * 9000 + '<html lang="de"> --><script>' + "y" * 9000 + '</script><HTML class=a lang="PT-br">') == "pt"
    assert language.declared_language("<html><p>a</p><html lang=fr>") is None
    assert language.fit_text(spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(70)], "text string, lang string")).log_prob.shape[0] == 70
    documents = spark.createDataFrame([(1, "aaaa aaaa aaaa", "s", "a"), (2, "bbbb bbbb bbbb", "s", "b")], "doc_id long, text string, source string, lang string")
    pages = [(i, f"http://h{i % 4}.c{i // 4}/", "aaaa aaaa") for i in range(4 * 1001)] + [(5000 + i, f"http://h{i}.zz/", "bbbb bbbb") for i in range(3)] + [(6000, "http://other.zz/", None)]
    got = {r["page_id"]: r["lang"] for r in language.identify(documents, spark.createDataFrame(pages, "page_id long, url string, html string")).where("kind = 'page'").collect()}
    assert len(got) == len(pages) and got[6000] == "b" and got[5000] == "b" and got[0] == "a"
