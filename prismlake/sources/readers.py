"""Readers: wide CSV, JCAMP-DX and plain ASCII spectra, and a registry of named readers.

Files are read by Spark (binaryFile, csv), one row per file; decoding a file is a small function in a
task. Broken files become rows with an error, never a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from importlib import import_module

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Readers by kind: a function, or where to find it when it is first asked for.
_REGISTRY: dict[str, Callable[..., DataFrame] | str] = {
    "csv": "prismlake.sources.readers:read_csv", "spectra": "prismlake.sources.readers:read_spectra", "synthetic": "prismlake.sources.readers:synthetic", "images": "prismlake.sources.images:read_images",
    "tecator": "prismlake.sources.readers:read_tecator",
}


def register(kind: str, reader: Callable[..., DataFrame]) -> None:
    """Adds a reader of one's own, or replaces one."""
    _REGISTRY[kind] = reader


def kinds() -> list[str]:
    return sorted(_REGISTRY)


def reader(kind: str) -> Callable[..., DataFrame]:
    if kind not in _REGISTRY:
        raise ValueError(f"unknown reader {kind!r}; known: {', '.join(kinds())}")
    found = _REGISTRY[kind]
    if isinstance(found, str):
        module, name = found.split(":")
        found = getattr(import_module(module), name)
    return found


def read(spark: SparkSession, kind: str, *args, **options) -> DataFrame:
    return reader(kind)(spark, *args, **options)


def _is_number(name: str) -> bool:
    return re.fullmatch(r"\s*[+-]?\d+([.,]\d+)?\s*", name) is not None


def read_csv(spark: SparkSession, path: str, label: str | None = None, conc: str | None = None, sep: str | None = None) -> DataFrame:
    """A wide table: columns with numeric names are the spectrum, the rest metadata. The separator is taken
    from the header line if not given. The axis is in the `wn` column, the same array in every row."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    sep = sep or max(";,\t", key=header[0].count)
    # every file's header must be that of the first, or its columns would be read under other names
    df = spark.read.csv(path, header=True, sep=sep, enforceSchema=False)
    axis = [c for c in df.columns if _is_number(c) and c not in (label, conc)]
    if not axis:
        raise ValueError(f"{path} has no column with a numeric name")
    number = lambda c: F.regexp_replace(F.col(f"`{c}`"), ",", ".").cast("double")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in axis and c not in (label, conc)]
    named = [F.col(f"`{label}`").cast("string").alias("label")] if label else []
    named += [number(conc).alias("conc")] if conc else []
    return df.select(*named, *rest, F.array(*(number(c) for c in axis)).alias("x"), F.lit([float(c.replace(",", ".")) for c in axis]).alias("wn"))


def preview_csv(spark: SparkSession, path: str, label: str | None = None, lo: float = float("-inf"), hi: float = float("inf"), n: int = 50) -> DataFrame:
    """The first n rows of a wide table, cut to the axis values in [lo, hi]: a look at a file, no load. Spark reads
    no more of the file than these rows need."""
    rows = read_csv(spark, path, label=label).limit(n)
    first = rows.select("wn").first()
    keep = [j for j, w in enumerate(first["wn"] if first else []) if lo <= w <= hi]
    cut = lambda c: F.transform(F.lit(keep).cast("array<int>"), lambda j: F.get(c, j)).alias(c)
    named = [F.col("label")] if label else [F.lit("?").alias("label")]
    return rows.select(*named, cut("wn"), cut("x"))


#: Fixed values of the Tecator file: the line before the data, lines and channels of a sample, its axis, and how many
#: samples are for training and for testing; the others are for extrapolation.
TECATOR_START, TECATOR_LINES, TECATOR_CHANNELS, TECATOR_AXIS, TECATOR_PARTS = "extrapolation_examples=25", 25, 100, (850.0, 1050.0), (172, 215)


def decode_tecator(text: str) -> list[tuple[int, list[float], float, float, float, str]]:
    """(number, absorbances, moisture, fat, protein, part) of each sample. The text before the last start line is
    prose; a number of lines that isn't one of whole samples is an error."""
    _, start, data = text.rpartition(TECATOR_START)
    lines = [ln.split() for ln in data.splitlines()[1:] if ln.strip()]
    if not start or len(lines) % TECATOR_LINES:
        raise ValueError("no start of the data" if not start else f"{len(lines)} lines are no whole samples of {TECATOR_LINES}")
    out = []
    for i in range(len(lines) // TECATOR_LINES):
        own = lines[i * TECATOR_LINES : (i + 1) * TECATOR_LINES]
        x = [float(v) for ln in own[:20] for v in ln]
        if len(x) != TECATOR_CHANNELS:
            raise ValueError(f"sample {i} has {len(x)} absorbances, not {TECATOR_CHANNELS}")
        moisture, fat, protein = (float(v) for v in own[-1][-3:])
        out.append((i, x, moisture, fat, protein, "train" if i < TECATOR_PARTS[0] else "test" if i < TECATOR_PARTS[1] else "extrapolation"))
    return out


def read_tecator(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, label, conc (fat), group_id, x, wn, moisture, protein, part of the public Tecator text. One file of
    some 240 samples, decoded in one task."""
    files = spark.read.text(path, wholetext=True)
    wn = np.linspace(*TECATOR_AXIS, TECATOR_CHANNELS).tolist()

    def samples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                rows = decode_tecator(text)
                yield pd.DataFrame([(i, "meat", fat, str(i), x, wn, moisture, protein, part) for i, x, moisture, fat, protein, part in rows], columns=["sample_id", "label", "conc", "group_id", "x", "wn", "moisture", "protein", "part"])

    return files.mapInPandas(samples, "sample_id long, label string, conc double, group_id string, x array<double>, wn array<double>, moisture double, protein double, part string")


#: Digit alphabets of the JCAMP-DX compressed forms, in order of the digits they stand for.
SQUEEZED = "@ABCDEFGHI", "abcdefghi"
DIFFERENCE = "%JKLMNOPQR", "jklmnopqr"
DUPLICATE = "STUVWXYZs"

_TOKEN = re.compile(r"([@A-Ia-i%J-Rj-rS-Zs+-]?)(\d*\.?\d*)")


def decode_line(line: str) -> tuple[float | None, list[float]]:
    """(check abscissa, ordinates) of one (X++(Y..Y)) line; a difference adds to the value before it, a
    duplicate count repeats the last step."""
    m = re.match(r"\s*([+-]?\d+(?:\.\d+)?)", line)
    x = float(m.group(1)) if m else None
    y: list[float] = []
    step: float | None = None
    for sign, digits in _TOKEN.findall(line[m.end() if m else 0 :].replace(",", " ")):
        if not sign and not digits:
            continue
        if sign and sign in DUPLICATE:
            count = int(f"{DUPLICATE.index(sign) + 1}{digits}")
            for _ in range(count - 1):
                if y:
                    y.append(y[-1] + step if step is not None else y[-1])
            continue
        for alphabet, difference in ((SQUEEZED, False), (DIFFERENCE, True)):
            if sign and sign in alphabet[0]:
                value = float(f"{alphabet[0].index(sign)}{digits}")
            elif sign and sign in alphabet[1]:
                value = -float(f"{alphabet[1].index(sign) + 1}{digits}")
            else:
                continue
            step = value if difference else None
            y.append((y[-1] if y else 0.0) + value if difference else value)
            break
        else:
            if digits not in ("", "."):
                step = None
                y.append(float(f"{sign if sign in '+-' else ''}{digits}"))
    return x, y


_LABEL = re.compile(r"##([^=]*)=(.*)")


def _label(line: str) -> tuple[str, str] | None:
    m = _LABEL.match(line)
    return (re.sub(r"[\s\-_/]", "", m.group(1)).upper(), m.group(2)) if m else None


def labels(text: str) -> dict[str, str]:
    """The labels of a JCAMP-DX text and what stands after them; the first of equal ones."""
    records: dict[str, str] = {}
    for line in text.splitlines():
        if (found := _label(line)) and found[0] != "END":
            records.setdefault(found[0], found[1].split("$$")[0].strip())
    return records


def data_lines(text: str) -> list[str]:
    """The lines under XYDATA."""
    lines, inside = [], False
    for line in text.splitlines():
        if found := _label(line):
            inside = found[0] == "XYDATA"
        elif inside and line.strip():
            lines.append(line.split("$$")[0])
    return lines


def decode_jcamp(text: str) -> tuple[dict[str, str], np.ndarray, np.ndarray]:
    """(records, axis, ordinates). The axis runs from FIRSTX to LASTX over NPOINTS; each line starts at the
    place of its check abscissa, and places no line fills are interpolated."""
    records, lines = labels(text), data_lines(text)
    number = lambda k, d=None: float(records[k].replace(",", ".")) if k in records else d
    n = int(number("NPOINTS", 0))
    if not lines or n < 2:
        raise ValueError("no XYDATA block or fewer than two points")
    first, last = number("FIRSTX"), number("LASTX")
    factor, xfactor = number("YFACTOR", 1.0), number("XFACTOR", 1.0)
    dx = (last - first) / (n - 1)
    y = np.full(n, np.nan)
    after = 0
    for line in lines:
        x, values = decode_line(line)
        at = int(round((x * xfactor - first) / dx)) if x is not None else after
        if not 0 <= at < n:
            at = after
        values = values[: n - at]
        y[at : at + len(values)] = values
        after = at + len(values)
    good = np.flatnonzero(~np.isnan(y))
    if not len(good):
        raise ValueError("no ordinates")
    return records, first + dx * np.arange(n), np.interp(np.arange(n), good, y[good]) * factor


def decode_ascii(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers a line with any separator and decimal comma or point; other lines are header."""
    x, y = [], []
    for line in text.splitlines():
        parts = [p.replace(",", ".") for p in re.split(r"[;\t ]+", line.strip())] if re.search(r"[;\t ]", line.strip()) else line.strip().split(",")
        try:
            a, b = (float(p) for p in parts[:2])
        except ValueError:
            continue
        x.append(a)
        y.append(b)
    if len(x) < 2:
        raise ValueError("fewer than two x y lines")
    return np.array(x), np.array(y)


#: What marks a binary format, as (words in UTF-16, words in bytes), and the programs it comes from.
BINARY = (
    (("Bomem", "Horizon"), (), "an ABB Bomem file"),
    ((), (b"PEPE",), "a PerkinElmer file"),
    ((), (b"OPUS",), "a Bruker OPUS file"),
)


def refused(head: bytes) -> str | None:
    """Why a file with these first bytes isn't read: formats of instruments are exported, not guessed at. Null
    for text; of bytes that no format claims, more than a fifth of control characters make a binary."""
    wide = head[:256].decode("utf-16-le", "ignore")
    for words, marks, maker in BINARY:
        if any(w in wide for w in words) or (b"\x00" in head[:64] or head[:4] in marks) and any(m in head[:256] for m in marks):
            return f"a binary format ({maker}): export it as JCAMP-DX or ASCII from the instrument's program"
    control = sum(1 for b in head[:64] if b < 9 or 13 < b < 32 or b == 127)
    return "a binary format: export it as JCAMP-DX or ASCII from the instrument's program" if b"\x00" in head[:512] or control > len(head[:64]) / 5 else None


def decode(text: str) -> tuple[dict[str, str], np.ndarray, np.ndarray]:
    """(labels, axis, ordinates) of a file's text, whichever of the two forms it has."""
    if "##" in text[:2000]:
        return decode_jcamp(text)
    return {}, *decode_ascii(text)


def read_spectra(spark: SparkSession, folder: str) -> DataFrame:
    """path, folder (class), title, wn, x, error: a row per .dx, .jdx, .txt, .csv or .spectrum file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(r"(?i)\.(dx|jdx|txt|csv|spectrum)$"))

    def decode_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                title, wn, x, error = None, None, None, None
                try:
                    if why := refused(bytes(content[:512])):
                        raise ValueError(why)
                    text = bytes(content).decode("latin-1")
                    records, wn, x = decode(text)
                    title = records.get("TITLE")
                except ValueError as e:
                    error = str(e)
                rows.append((path, path.rsplit("/", 2)[-2], title, None if wn is None else wn.tolist(), None if x is None else x.tolist(), error))
            yield pd.DataFrame(rows, columns=["path", "folder", "title", "wn", "x", "error"])

    return files.select("path", "content").mapInPandas(decode_files, "path string, folder string, title string, wn array<double>, x array<double>, error string")


def synthetic(spark: SparkSession, classes: int = 3, levels: int = 10, replicates: int = 3, channels: int = 60, noise: float = 0.01, seed: int = 42) -> DataFrame:
    """Gaussian bands per class, a marker band that grows with concentration, replicates per sample."""
    rows = spark.range(classes * levels * replicates).select(
        F.col("id").alias("sample_id"), (F.col("id") % classes).cast("int").alias("k"), ((F.col("id") / classes).cast("long") % levels).alias("level"), F.expr(f"id div {classes * levels}").alias("replicate")
    )
    conc = F.col("level") * (40.0 / max(levels - 1, 1))
    at = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda j: j / F.lit(float(channels - 1)))
    band = lambda t, c, w: F.exp(-((t - c) * (t - c)) / (2 * w * w))
    centre = F.lit(0.2) + 0.6 * F.col("k") / max(classes - 1, 1)
    jitter = lambda j: (F.pmod(F.xxhash64(F.lit(seed), F.col("sample_id"), j), F.lit(10007)) / 10007.0 - 0.5) * 2 * noise
    x = F.transform(at, lambda t, j: band(t, centre, 0.08) + conc / 40.0 * band(t, F.lit(0.5), 0.05) + 0.3 * t + jitter(j))
    return rows.select("sample_id", F.concat(F.lit("C"), F.col("k")).alias("label"), conc.alias("conc"), F.concat_ws("-", F.concat(F.lit("C"), F.col("k")), F.format_string("%02d", "level")).alias("group_id"), x.alias("x"))

