"""WARC archives against a plain reading of the files and of the pages."""

import glob
import gzip
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.llm import warc

SCHEMA = "page_id long, url string, html string"
LONG = "".join(chr(int(c)) for c in np.random.default_rng(3).choice([65, 10, 13, 228, 8364, 128512], 30_000))
ROWS = [
    (5, "http://a.b/", LONG), (3, "http://a.b/c d%20", LONG), (4, None, LONG), (7, "x\r\nWARC/1.1", "y" * 100), (9, "u", "y" * 100), (9, "u", "y" * 100), (2, "", "y" * 99), (1, "", "y" * 99),
    (None, "n", LONG), (None, "n", None), (10, "e", ""), (11, "e", "WARC/1.1\r\n\r\n" * 20),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("z") for c in ("record", "chunk", "bytes", "digest", "data")})


def plain(rows):
    """The contract's rows, by a loop: of equal large payloads the first by page_id, nulls last, is kept."""
    groups = {}
    for i, (page, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is None, page or 0, i))
    out = []
    for payload, members in groups.items():
        first = min(members)
        for m in members:
            page = rows[m[2]][0]
            again = len(payload) >= 100 and m != first
            out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", rows[first[2]][0] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1 << 18, 1000, 7])
def test_round_trip(spark, pages, tmp_path, size):
    path = warc.archive(pages, f"file://{tmp_path}/out", size)
    assert sorted((tuple(r) for r in warc.records(spark, path).collect()), key=repr) == plain(ROWS)
    # texts and addresses come back too
    got = {r["url"]: b"".join(bytes(c["data"]) for c in sorted(r["c"])) for r in warc.read(spark, path).where("record_type = 'response'").groupBy("url", "record_id").agg(F.collect_list(F.struct("chunk", "data")).alias("c")).collect()}
    assert got["http://a.b/c d%20"].decode() == LONG and got["x\r\nWARC/1.1"] == b"y" * 100 and got["n"] == b""


def test_files_are_plain_warc(spark, pages, tmp_path):
    """A reader of its own: every record has the length it says, each is one gzip member."""
    path = warc.archive(pages, f"file://{tmp_path}/out", 1000)
    kinds = []
    for f in glob.glob(f"{tmp_path}/out/*.warc.gz"):
        data = gzip.open(f).read()
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.1\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            kinds.append(re.search(rb"WARC-Type: (\w+)", head)[1].decode())
            assert data[n : n + 4] == b"\r\n\r\n"
            data = data[n + 4 :]
    want = [r[3] for r in plain(ROWS)]
    assert (kinds.count("response"), kinds.count("revisit")) == (want.count("response"), want.count("revisit"))


def test_empty_damaged_and_foreign_files(spark, pages, tmp_path):
    assert warc.records(spark, warc.archive(pages.limit(0), f"file://{tmp_path}/none")).count() == 0
    path = warc.archive(pages, f"file://{tmp_path}/out")
    (tmp_path / "out/part-lost.warc.gz").write_bytes(b"left by a lost attempt")
    assert warc.records(spark, path).count() == len(ROWS)
    (tmp_path / "out/part-lost.warc.gz").unlink()
    for f in glob.glob(f"{tmp_path}/out/*.warc.gz"):
        records = [r for r in re.split(rb"(?=WARC/1.1\r\nWARC-Type)", gzip.open(f).read()) if b"WARC-Type: response" not in r]
        with gzip.open(f, "wb") as out:
            out.write(b"".join(records))
    with pytest.raises(Exception, match="without its response"):
        warc.records(spark, path).collect()


def test_hot_payload(spark):
    """A payload that most pages share, over many partitions."""
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 < 2, F.lit("h" * 200)).otherwise(F.concat(F.lit("i" * 100), F.col("id").cast("string"))).alias("html")).repartition(16)
    got = warc.digests(pages).groupBy("record_type").agg(F.count("*").alias("n"), F.max("refers_to").alias("r")).collect()
    assert {(r["record_type"], r["n"], r["r"]) for r in got} == {("response", 1334, None), ("revisit", 2666, 0)}
