"""Personal data: base patterns, and a skip-chain conditional random field that adds spans.

Nodes of the field are the words that hold a digit or `@`. Neighbouring nodes share a chain potential;
each node shares a skip potential with the next one of equal or like spelling in its document, however
far away, so that one number or address gets one label throughout. Marginals come from loopy message
passing, on all graphs of a slice at once.

The field learns from the base patterns: nodes in base spans carry their kind, others none. Unary
weights are a softmax regression on spelling and context; pair potentials are smoothed log ratios of
label pairs on the edges (piecewise training). Nodes whose marginal for a kind passes `confidence`
become spans of that kind, unless a base span holds them.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.textkernel import Texts, over_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents for fitting, at most (by hash of doc_id): the bound of the driver's data.
SAMPLE_DOCUMENTS = 2000
#: ... and nodes of each: of a document with more, a stretch of them from a place that a hash decides on.
SAMPLE_NODES = 200
CONFIDENCE = 0.95
CHAIN_REACH = 3

_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_INTEREST = np.isin(np.arange(256), list(b"0123456789@"))
_DIGITS = frozenset("0123456789")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed in KINDS, then start. Failing matches are dropped."""
    found = []
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    at = text.find("+")
    if at >= 0:
        for m in _PHONE.finditer(text, at):
            if 8 <= sum(c in _DIGITS for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


FEATURES = 96


def _describe(word: str, before: str, after: str) -> list[int]:
    """Indexes of the binary features of a node; its own spelling and the words beside it."""
    digits = sum(c in _DIGITS for c in word)
    letters = sum(c.isalpha() for c in word)
    plain = word.strip(".,;:!?()[]\"'")
    number = "".join(c for c in plain if c in _DIGITS)
    on = [
        0, 1 + min(digits, 20), 24 + min(letters, 10), 36 + min(plain.count("."), 5), 42 + min(plain.count("-"), 4), 48 + min(len(plain) // 4, 9),
    ]
    flags = ("@" in word, word.startswith("+"), "(" in word, "=" in word, '"' in word, _DOMAIN.search(plain.split("@")[-1]) is not None, before.startswith("+"), "(" in before, any(c in _DIGITS for c in before), any(c in _DIGITS for c in after), digits == len(plain), 16 <= len(number) <= 19 and _luhn(number), all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in plain.split(".")))
    on += [60 + i for i, f in enumerate(flags) if f]
    # a small hash of the word before: context such as "call" or "token"
    on.append(80 + hashlib.blake2b(before.lower().encode("utf-8", "replace"), digest_size=2).digest()[0] % 16)
    return on


class Graph:
    """Nodes and edges of many documents. edges: (i, j, kind of potential: 0 chain, 1 skip)."""

    def __init__(self) -> None:
        self.row: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.features: list[list[int]] = []
        self.label: list[int] = []
        self.edges: list[tuple[int, int, int]] = []

    def add(self, row: int, text: str, spans: list[tuple[str, int, int]]) -> None:
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        last: dict[str, int] = {}
        previous = None
        spans = sorted(spans, key=lambda s: s[1])
        at = 0
        for w, (a, b) in enumerate(words):
            word = text[a:b]
            if "@" not in word and not any(c in _DIGITS for c in word):
                continue
            node = len(self.row)
            while at < len(spans) and spans[at][2] <= a:
                at += 1
            inside = next((LABELS.index(k) for k, s, e in spans[at : at + 4] if s < b and e > a), 0)
            plain = word.strip(".,;:!?()[]\"'").lower()
            self.row.append(row)
            self.start.append(a + word.find(plain[:1]) if plain and plain[:1] in word else a)
            self.end.append(self.start[-1] + len(plain) if plain else b)
            self.features.append(_describe(word, text[slice(*words[w - 1])] if w else "", text[slice(*words[w + 1])] if w + 1 < len(words) else ""))
            self.label.append(inside)
            if previous is not None and w - previous[1] <= CHAIN_REACH:
                self.edges.append((previous[0], node, 0))
            previous = (node, w)
            # equal spelling, else equal digits
            for key in {plain, "#" + "".join(c for c in plain if c in _DIGITS)} - {"", "#"}:
                if key in last and last[key] != node and (last[key], node, 1) not in self.edges[-2:]:
                    self.edges.append((last[key], node, 1))
                last[key] = node


class Field:
    """Weights of the field: unary (features x labels) and log potentials (2 x labels x labels)."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def marginals(self, g: Graph, rounds: int = 30) -> np.ndarray:
        """Loopy sum-product with damping; chains and trees converge to exact marginals."""
        n = len(g.row)
        local = np.zeros((n, len(LABELS)))
        for i, on in enumerate(g.features):
            local[i] = self.unary[on].sum(0)
        if g.edges:
            e = np.array(g.edges)
            fro, to = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            pair = self.pair[e[:, 2]]
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
            message = np.zeros((len(fro), len(LABELS)))
            for _ in range(rounds):
                belief = local.copy()
                np.add.at(belief, to, message)
                out = (belief[fro] - message[back])[:, :, None] + pair
                top = out.max(1, keepdims=True)
                new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                moved = np.abs(new - message).max()
                message = 0.5 * message + 0.5 * new
                if moved < 1e-4:
                    break
            np.add.at(local, to, message)
        local -= local.max(1, keepdims=True)
        p = np.exp(local)
        return p / p.sum(1, keepdims=True)


def _interesting(t: Texts) -> np.ndarray:
    return np.flatnonzero(t.count(_INTEREST) > 0)


def fit(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, steps: int = 200) -> Field | None:
    """The field, from at most sample_documents documents with a digit or `@`; None if there is none.

    Tasks make the nodes (features, labels, edges); the driver gets these of the sample only, SAMPLE_NODES of a
    document at most.
    """
    some = documents.where("doc_id is not null and text rlike '[0-9@]'").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_documents)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("text")

    def nodes(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        g = Graph()
        for r, text in enumerate(piece.column(0).to_pylist()):
            g.add(r, text or "", base_spans(text or ""))
        if not g.row:
            return None
        after: list[list[dict]] = [[] for _ in g.row]
        for i, j, kind in g.edges:
            after[i].append({"label": g.label[j], "kind": kind})
        keep = []
        for r in range(piece.num_rows):
            own = range(*np.searchsorted(g.row, [r, r + 1]))
            spare = len(own) - SAMPLE_NODES
            begin = zlib.crc32((piece.column(0)[r].as_py() or "").encode("utf-8", "replace")) % (spare + 1) if spare > 0 else 0
            keep += own[begin : begin + SAMPLE_NODES]
        g.label, g.features, after = ([v[i] for i in keep] for v in (g.label, g.features, after))
        pairs = pa.list_(pa.struct([("label", pa.int32()), ("kind", pa.int32())]))
        return pa.record_batch([pa.array(g.label, pa.int32()), pa.array(g.features, pa.list_(pa.int32())), pa.array(after, pairs)], ["label", "features", "pairs"])

    got = over_texts(rows, nodes, "label int, features array<int>, pairs array<struct<label int, kind int>>").toPandas()
    if not len(got):
        return None
    x = np.zeros((len(got), FEATURES))
    for i, on in enumerate(got["features"]):
        x[i, on] = 1
    y = np.eye(len(LABELS))[got["label"].to_numpy()]
    w, m, v = np.zeros((FEATURES, len(LABELS))), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam, full batch
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = x.T @ (p - y) / len(x) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    count = np.ones((2, len(LABELS), len(LABELS)))
    for label, pairs in zip(got["label"], got["pairs"], strict=True):
        for q in pairs:
            count[q["kind"], label, q["label"]] += 1
            count[q["kind"], q["label"], label] += 1
    joint = count / count.sum((1, 2), keepdims=True)
    ratio = np.log(joint) - np.log(joint.sum(2, keepdims=True)) - np.log(joint.sum(1, keepdims=True))
    return Field(w, np.clip(ratio, -3, 3))


def all_spans(text: str, base: list[tuple[str, int, int]], g: Graph, nodes: np.ndarray, marginals: np.ndarray, confidence: float) -> list[tuple[str, int, int]]:
    """Base spans and those that the field adds, by kind as listed, then start."""
    out = list(base)
    taken = sorted((s, e) for _, s, e in base)
    for i in nodes:
        k = int(np.argmax(marginals[i]))
        if k and marginals[i, k] >= confidence and not any(s < g.end[i] and e > g.start[i] for s, e in taken):
            out.append((LABELS[k], g.start[i], g.end[i]))
    # parts of one number or name that only white space parts are one span
    added = sorted(set(out) - set(base), key=lambda s: (s[0], s[1]))
    merged: list[tuple[str, int, int]] = []
    for kind, s, e in added:
        if merged and merged[-1][0] == kind and s >= merged[-1][2] and not text[merged[-1][2] : s].strip(" ().-"):
            merged[-1] = (kind, merged[-1][1], e)
        else:
            merged.append((kind, s, e))
    return sorted({*base, *merged}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _slice_spans(t: Texts, field: Field | None, confidence: float):
    """{row: (base spans, all spans)} of the rows with any digit or `@`."""
    g, base, texts = Graph(), {}, {}
    for r in _interesting(t):
        text = t.column[int(r)].as_py()
        texts[r], base[r] = text, base_spans(text)
        if field is not None:
            g.add(int(r), text, base[r])
    p = field.marginals(g) if field is not None and g.row else None
    by_row: dict[int, list[int]] = {}
    for i, r in enumerate(g.row):
        by_row.setdefault(r, []).append(i)
    return {r: (base[r], all_spans(texts[r], base[r], g, by_row.get(r, []), p, confidence) if p is not None else base[r]) for r in base}


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(documents: DataFrame, field: Field | None, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans: a row per document.

    Places are code points, ends exclusive. Null and empty texts have no spans; repeated rows give a row
    each; an empty table gives none; further columns are ignored.
    """

    def detect(piece: pa.RecordBatch) -> pa.RecordBatch:
        t = Texts(piece.column(1))
        found = _slice_spans(t, field, confidence)
        none = hashlib.sha256(b"").hexdigest()
        counts = np.zeros((len(KINDS), t.n), np.int64)
        digests, spans = [none] * t.n, [""] * t.n
        for r, (base, every) in found.items():
            for k, _, _ in base:
                counts[KINDS.index(k), r] += 1
            digests[r], spans[r] = hashlib.sha256(_join(base).encode()).hexdigest(), _join(every)
        return pa.record_batch([piece.column(0), *(pa.array(c) for c in counts), pa.array(digests), pa.array(spans)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_texts(chosen, detect, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(documents: DataFrame, field: Field | None, confidence: float = CONFIDENCE) -> DataFrame:
    """The documents with every span replaced by `<kind>` (overlapping spans by the first's kind); all
    columns stay, n_chars (where there is one) is the new length. Null texts stay null."""
    at = documents.columns.index("text")
    chars = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def hide(piece: pa.RecordBatch) -> pa.RecordBatch:
        t = Texts(piece.column(at))
        found = {r: every for r, (_, every) in _slice_spans(t, field, confidence).items() if every}
        if not found:
            return piece
        texts = piece.column(at).to_pylist()
        sizes = piece.column(chars).to_pylist() if chars is not None else None
        for r, spans in found.items():
            text, out, done = texts[r], [], 0
            for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                if s >= done:
                    out += [text[done:s], f"<{kind}>"]
                done = max(done, e)
            texts[r] = "".join(out) + text[done:]
            if sizes is not None:
                sizes[r] = len(texts[r])
        columns = list(piece.columns)
        columns[at] = pa.array(texts, piece.column(at).type)
        if sizes is not None:
            columns[chars] = pa.array(sizes, piece.column(chars).type)
        return pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    return over_texts(documents, hide, documents.schema)
