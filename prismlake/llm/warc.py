"""WARC archives written from pages and read back, as a table of chunks.

A payload never travels whole: it is cut into rows of (record, chunk), and a task that sees the chunks of a
record in order carries their digest on from row to row, so that each row tells the SHA-256 of the payload up
to its end. The sink writes such rows as WARC 1.1 records, one gzip member each, and the source yields them
again, both a chunk at a time.

Files are committed by a manifest: a task writes under a name of its own and reports it; the driver lists the
names of the tasks that ended well. What a lost attempt leaves behind is never read. Archives are opened with
pyarrow.fs, so the folder may be any that it knows (file, hdfs, s3, gs).

Captures: payloads of REVISIT_BYTES or more that are equal (by length and digest) are stored once, in the
record of the least page_id; the others refer to it. Nulls: a null html is an empty payload, a null url an
empty one, a null page_id stands after all others. Repeated rows are captures of their own, of which the first
in file order is stored. No pages: an archive folder without archives. Columns other than page_id, url and
html are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from prismlake.llm.lookups import lookup
from prismlake.llm.staging import discard, filesystem, shared_dir, staged

CHUNK_BYTES, ARCHIVE_BYTES, REVISIT_BYTES = 256 << 10, 1 << 30, 100
#: Arrow batches hold so many bytes of chunks at most.
BATCH_BYTES = 8 << 20
#: Revisits and oversized records whose facts are broadcast to the writers; more are joined by a shuffle.
MOST_BROADCAST = 500_000
MANIFEST = "_archives.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = "record long, page_id long, url string, chunk int, chunks int, data binary, bytes long, digest string"
#: What the sink takes: the facts of the whole record beside each chunk.
SINK_SCHEMA = "record long, page_id long, url string, chunk int, data binary, payload_bytes long, payload_digest string, refers_record long, refers_url string"
#: What the source yields. bytes and digest are of the payload up to the end of the chunk; declared is the header's.
SOURCE_SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to_record string, declared string, chunk int, last boolean, data binary, bytes long, digest string"


def chunk_rows(pages: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """CHUNK_SCHEMA: the payloads of pages in pieces of `size` bytes, in order, with running length and digest."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    n = F.greatest(F.ceil(F.length(payload) / size).cast("int"), F.lit(1))

    def cut(v):
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("chunk"), F.substring(v, k * F.lit(size) + 1, F.lit(size)).alias("data")))

    # the number is given before the rows are cut, as one select would count the pieces
    numbered = pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("record"))
    rows = numbered.select(
        "record", F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), n.alias("chunks"),
        F.explode(F.element_at(F.transform(F.array(payload), cut), 1)).alias("c"),
    ).select("record", "page_id", "url", "c.chunk", "chunks", "c.data")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, so_far = None, 0
        for b in batches:
            chunk, data = b.column(3).to_pylist(), b.column(5)
            lengths, digests = [], []
            for i, k in enumerate(chunk):
                if k == 0:
                    state, so_far = hashlib.sha256(), 0
                view = data[i].as_buffer()
                state.update(view)
                so_far += len(view)
                lengths.append(so_far)
                digests.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lengths, pa.int64()), pa.array(digests, pa.string())], [*b.schema.names, "bytes", "digest"])

    return rows.mapInArrow(digest, CHUNK_SCHEMA)


def captures(heads: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """heads (record, page_id, url, bytes, digest) with refers_record and refers_url: of the record that holds
    an equal payload, null for those that hold their own."""
    big = heads.where(F.col("bytes") >= least)
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record", "url")
    groups = staged(big.groupBy("digest", "bytes").agg(F.min(first).alias("f"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", F.col("f.record").alias("refers_record"), F.col("f.url").alias("refers_url")), "warc-groups")
    other = F.col("refers_record") != F.col("record")
    found = lookup(heads, groups, ["digest", "bytes"])
    return found.withColumns({c: F.when(other, F.col(c)) for c in ("refers_record", "refers_url")})


def archive(pages: DataFrame, path: str | None = None, size: int = CHUNK_BYTES) -> str:
    """Writes the pages as WARC archives into a new folder (given, or in the shared one) and returns its path."""
    spark = pages.sparkSession
    spark.dataSource.register(Warc)
    path = path or f"{shared_dir(spark)}/prismlake/warc-{uuid.uuid4().hex}"
    chunks = staged(chunk_rows(pages, size), "warc-chunks", codec="zstd")
    heads = staged(chunks.where("chunk = chunks - 1").select("record", "page_id", "url", "bytes", "digest", "chunks"), "warc-heads")
    # only revisits and records of several chunks need facts that their chunks don't carry themselves
    facts = staged(
        captures(heads.drop("chunks")).join(heads.where("chunks > 1").select("record", F.lit(True).alias("wide")), "record", "left")
        .where("wide or refers_record is not null").select("record", F.col("bytes").alias("all_bytes"), F.col("digest").alias("all_digest"), "refers_record", "refers_url"), "warc-facts"
    )
    few = facts.count() <= MOST_BROADCAST
    rows = chunks.join(F.broadcast(facts) if few else facts, "record", "left").where("refers_record is null or chunk = 0")
    rows = rows.select(
        "record", "page_id", "url", "chunk", F.when(F.col("refers_record").isNull(), F.col("data")).alias("data"), F.coalesce("all_bytes", "bytes").alias("payload_bytes"), F.coalesce("all_digest", "digest").alias("payload_digest"), "refers_record", "refers_url"
    )
    rows.repartition("record").sortWithinPartitions("record", "chunk").write.format("warc").mode("append").save(path)
    discard(chunks)
    return path


def read(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    """SOURCE_SCHEMA of all archives under path; without data the payloads are read and digested but not returned."""
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("data", str(data).lower()).load(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are those of the bytes read; a revisit has its response's. A payload that isn't what its
    header declares, or a revisit whose response is missing, fails the query."""
    read_back = read(spark, path, data=False).where("last")
    heads = staged(read_back.select("record_id", "page_id", "record_type", "refers_to_record", "declared", "bytes", "digest"), "warc-read")
    intact = F.when(F.col("declared") != F.concat(F.lit("sha256:"), F.col("payload_digest")), F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record_id"))))
    stored = heads.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("of_bytes"), F.col("digest").alias("of_digest"))
    revisits = lookup(heads.where("record_type = 'revisit'"), stored, ["refers_to_record"]).withColumns(
        {"payload_bytes": F.coalesce("of_bytes", F.raise_error(F.lit("a revisit without its response"))), "payload_digest": F.col("of_digest")}
    )
    responses = heads.where("record_type = 'response'").withColumns({"payload_bytes": F.col("bytes"), "payload_digest": F.col("digest"), "refers_to": F.lit(None).cast("long")})
    columns = ["page_id", "payload_bytes", F.coalesce(intact, F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to"]
    return responses.select(*columns).unionAll(revisits.select(*columns))


def digests(pages: DataFrame) -> DataFrame:
    """The pages written to archives and read back: records() of a new folder."""
    return records(pages.sparkSession, archive(pages))


# ------------------------------------------------------------------ sink and source


class Warc(DataSource):
    """spark.read.format("warc") and df.write.format("warc"), after spark.dataSource.register(Warc)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SOURCE_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], str(self.options.get("data", "true")).lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are appended; give a new folder to write anew")
        return _Writer(self.options["path"], schema.fieldNames())


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.run = path, names, uuid.uuid4().int >> 64

    def record_id(self, record: int) -> str:
        return f"<{uuid.UUID(int=(self.run << 64) | record).urn}>"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        out, files, packer, left = None, [], None, 0
        for b in iterator:
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                row = {n: column[n][i].as_py() for n in self.names if n != "data"}
                if row["chunk"] == 0:
                    if packer is not None:
                        raise ValueError("a record ended before all its payload was written")
                    if out is None or out.tell() > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = fs.open_output_stream(f"{root}/{files[-1]}", compression=None)
                        out.write(gzip.compress(_head("warcinfo", f"<{uuid.uuid4().urn}>", {"Content-Type": "application/warc-fields"}, 21) + b"format: WARC File 1.1" + b"\r\n\r\n"))
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    head, left = self.head(row)
                    out.write(packer.compress(head))
                if left:
                    view = column["data"][i].as_buffer()
                    left -= len(view)
                    out.write(packer.compress(view))
                if left == 0:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    packer = None
                elif left < 0:
                    raise ValueError("a payload longer than its record says")
        if packer is not None:
            raise ValueError("a record ended before all its payload was written")
        if out is not None:
            out.close()
        return Written(files)

    def head(self, row: dict) -> tuple[bytes, int]:
        """Header lines of a record up to its payload, and the payload bytes that follow."""
        revisit = row["refers_record"] is not None
        stored = 0 if revisit else row["payload_bytes"]
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
        fields = {"Content-Type": "application/http; msgtype=response", "WARC-Target-URI": _plain(row["url"]), "WARC-Payload-Digest": f"sha256:{row['payload_digest']}"}
        if row["page_id"] is not None:
            fields["X-Page-Id"] = str(row["page_id"])
        if revisit:
            fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": self.record_id(row["refers_record"]), "WARC-Refers-To-Target-URI": _plain(row["refers_url"] or "")}
        return _head("revisit" if revisit else "response", self.record_id(row["record"]), fields, len(http) + stored) + http, stored

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        done = [f for m in messages if m is not None for f in m.files]
        have = _manifest(fs, root)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(have + done).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{root}/{f}")


def _plain(uri: str) -> str:
    """A URI of one header line: control characters, white space and % escaped; unquote() turns it back."""
    return re.sub(r"[\x00-\x20%\x7f-\x9f  ]", lambda m: quote(m[0], safe=""), uri)


def _head(kind: str, record_id: str, fields: dict[str, str], length: int) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": "1970-01-01T00:00:00Z", **fields, "Content-Length": str(length)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode()


def _manifest(fs, root: str) -> list[str]:
    from pyarrow.fs import FileType

    if fs.get_file_info(f"{root}/{MANIFEST}").type == FileType.NotFound:
        return []
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


class _Reader(DataSourceReader):
    def __init__(self, path: str, data: bool):
        self.path, self.data = path, data

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _manifest(*filesystem(self.path))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        fs, root = filesystem(self.path)
        names = [f.split()[0] for f in SOURCE_SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([pa.field(n, kinds[f.split()[1]]) for n, f in zip(names, SOURCE_SCHEMA.split(", "), strict=True)])
        rows, size = [], 0
        with fs.open_input_stream(f"{root}/{partition.value}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for row in parse(stream):
                rows.append(row if self.data else (*row[:8], None, *row[9:]))
                size += len(row[8]) if self.data else 200
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _fields(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def parse(stream, size: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of SOURCE_SCHEMA from the bytes of an archive: a payload is read in pieces, never whole. Records
    that are neither response nor revisit are passed over."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        field = _fields(stream)
        left, kind = int(field["content-length"]), field.get("warc-type")
        wanted = kind in ("response", "revisit")
        if wanted and field.get("content-type", "").startswith("application/http"):
            while left and (head := stream.readline()):
                left -= len(head)
                if not head.strip():
                    break
        state, so_far, chunk = hashlib.sha256(), 0, 0
        page = field.get("x-page-id")
        about = (field.get("warc-record-id"), int(page) if page else None, unquote(field.get("warc-target-uri", "")), kind, field.get("warc-refers-to"), field.get("warc-payload-digest"))
        while left or (wanted and chunk == 0):
            data = stream.read(min(left, size))
            if left and not data:
                raise ValueError("the archive ends within a record")
            left -= len(data)
            if wanted:
                state.update(data)
                so_far += len(data)
                yield (*about, chunk, left == 0, data, so_far, state.hexdigest())
                chunk += 1
