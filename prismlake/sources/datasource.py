"""Instrument files as a Spark data source, and a sink for copies without provenance.

spark.read.format("spectra").load(folder) gives a row per file; a schema without wn and x, or the option
headers=true, reads no more of a file than its header. df.write.format("sanitised") writes one file for each
name, under a keyed hash of the name, scans what it wrote by another rule, and publishes all files or none.

Both go through pyarrow.fs, so folders may be on any store that it knows (local, hdfs, s3, gs). register(spark)
makes the two formats known.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from prismlake.sources import readers

#: Extensions of spectra, in lower case.
EXTENSIONS = ("dx", "jdx", "txt", "csv", "spectrum")
SCHEMA = "path string, folder string, title string, first_x double, last_x double, n_points long, bytes_read long, wn array<double>, x array<double>, error string"
#: Bytes of files in one partition, and bytes of a header that are read at a time.
PARTITION_BYTES, BLOCK = 32 << 20, 4096
#: A file opens its data with one of these.
_DATA = re.compile(rb"^##\s*(XYDATA|XYPOINTS|PEAKTABLE)", re.I | re.M)

def register(spark: SparkSession) -> None:
    spark.dataSource.register(Spectra)
    spark.dataSource.register(Sanitised)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


class Spectra(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spectra"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        names = schema.fieldNames()
        headers = str(self.options.get("headers", "false")).lower() == "true" or not {"wn", "x"} & set(names)
        return _SpectraReader(self.options["path"], names, headers)


@dataclass
class Files(InputPartition):
    paths: list[str]


class _SpectraReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], headers: bool):
        self.path, self.names, self.headers = path, names, headers

    def partitions(self) -> list[InputPartition]:
        fs, root = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=False))
        files = sorted((f.path, f.size or 0) for f in found if f.type == pafs.FileType.File and f.path.rsplit(".", 1)[-1].lower() in EXTENSIONS)
        parts: list[InputPartition] = []
        held, size = [], 0
        for path, n in files:
            held.append(path)
            size += BLOCK if self.headers else n + BLOCK
            if size >= PARTITION_BYTES:
                parts.append(Files(held))
                held, size = [], 0
        return [*parts, Files(held)] if held or not parts else parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}
        fields = [pa.field(n, kinds[t]) for n, t in (f.split() for f in SCHEMA.split(", ")) if n in self.names]
        fields.sort(key=lambda f: self.names.index(f.name))
        rows: list[dict] = []
        for path in partition.paths:
            rows.append(_header(fs, path) if self.headers else _whole(fs, path))
            if len(rows) == 64:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _about(path: str) -> dict:
    return {"path": path, "folder": path.rsplit("/", 2)[-2]}


def _facts(records: dict[str, str]) -> dict:
    def number(k: str) -> float | None:
        try:
            return float(records[k].replace(",", "."))
        except (KeyError, ValueError):
            return None

    n = number("NPOINTS")
    return {"title": records.get("TITLE") or None, "first_x": number("FIRSTX"), "last_x": number("LASTX"), "n_points": None if n is None else int(n)}


def _header(fs: pafs.FileSystem, path: str) -> dict:
    """What the labels before the data say: blocks are read until the data begin."""
    head = b""
    with fs.open_input_stream(path) as f:
        while not (m := _DATA.search(head)) and (block := f.read(BLOCK)):
            head += block
            if why := readers.refused(head):
                return _about(path) | {"bytes_read": len(head), "error": why}
    read = len(head)
    head = head[: m.start()] if m else head
    if b"##" not in head:
        return _about(path) | {"bytes_read": read, "error": "no labels"}
    return _about(path) | _facts(readers.labels(head.decode("latin-1"))) | {"bytes_read": read}


def _whole(fs: pafs.FileSystem, path: str) -> dict:
    with fs.open_input_stream(path) as f:
        content = f.read()
    out = _about(path) | {"bytes_read": len(content)}
    try:
        if why := readers.refused(content):
            raise ValueError(why)
        records, wn, x = readers.decode(content.decode("latin-1"))
    except ValueError as e:
        return out | {"error": str(e)}
    facts = _facts(records)
    return out | {"title": facts["title"], "first_x": float(wn[0]), "last_x": float(wn[-1]), "n_points": len(wn), "wn": wn.tolist(), "x": x.tolist()}


# ------------------------------------------------------------------ copies without provenance


def keyed(key: str, text: str) -> str:
    """16 hexadecimal digits of a keyed hash."""
    return hmac.new(key.encode(), text.encode(), hashlib.sha256).hexdigest()[:16]


#: What must not be in a copy: another rule than the one by which lines are left out.
LEFT_OVER = re.compile(r"##\s*\$?\s*(audit|owner|origin|operator|path|filename|(detector|spectrometer|accessory)\s*model)|instrument id|detector id", re.I)


class Sanitised(DataSource):
    """Sink of rows (name, n, line): a file per name, its lines by n. Options: path, key (of the hash of names)
    and extension. The rows of a name must stand together, by n: write_sanitised() sees to it."""

    @classmethod
    def name(cls) -> str:
        return "sanitised"

    def schema(self) -> str:
        return "name string, n long, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not self.options.get("key"):
            raise ValueError("names are hashed with a key: give the option key")
        return _SanitisedWriter(self.options["path"], self.options["key"], self.options.get("extension", "dx"), schema.fieldNames())


@dataclass
class Copied(WriterCommitMessage):
    files: list[tuple[str, str]]  # (pending path, final path)
    left_over: list[str]


class _SanitisedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, extension: str, names: list[str]):
        self.path, self.key, self.extension, self.names, self.run = path, key, extension, names, uuid.uuid4().hex

    def pending(self, root: str) -> str:
        return f"{root}/.pending-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Copied:
        fs, root = filesystem(self.path)
        fs.create_dir(self.pending(root), recursive=True)
        done = Copied([], [])
        out, now = None, None

        def close() -> None:
            if out is not None:
                out.close()
                pending = done.files[-1][0]
                with fs.open_input_stream(pending) as f:  # what stands in the file, not what was meant to
                    if LEFT_OVER.search(f.read().decode("utf-8", "replace")):
                        done.left_over.append(pending)

        for b in iterator:
            names, lines = b.column(self.names.index("name")).to_pylist(), b.column(self.names.index("line")).to_pylist()
            for name, line in zip(names, lines, strict=True):
                if name != now:
                    close()
                    file = f"{keyed(self.key, name)}.{self.extension}"
                    done.files.append((f"{self.pending(root)}/{uuid.uuid4().hex}", f"{root}/{file}"))
                    out, now = fs.open_output_stream(done.files[-1][0], compression=None), name
                out.write(f"{line or ''}\n".encode())
        close()
        return done

    def commit(self, messages: list[Copied | None]) -> None:
        fs, root = filesystem(self.path)
        parts = [m for m in messages if m is not None]
        final = [f for m in parts for _, f in m.files]
        try:
            if left := [f for m in parts for f in m.left_over]:
                raise ValueError(f"{len(left)} copies still name their origin; nothing was written")
            if len(set(final)) < len(final):
                raise ValueError("two parts wrote one name: rows of a name must stand together")
            if taken := [i.path for i in fs.get_file_info(final) if i.type != pafs.FileType.NotFound]:
                raise ValueError(f"{len(taken)} copies exist already, the first {taken[0]}")
            for m in parts:
                for pending, path in m.files:
                    fs.move(pending, path)
        finally:
            self.clear()

    def abort(self, messages: list[Copied | None]) -> None:
        self.clear()

    def clear(self) -> None:
        fs, root = filesystem(self.path)
        if fs.get_file_info(self.pending(root)).type == pafs.FileType.Directory:
            fs.delete_dir(self.pending(root))


def write_sanitised(lines: DataFrame, path: str, key: str, extension: str = "dx") -> None:
    """lines (name, n, line) as copies under path: all of them, or, where one of them still names its origin or
    exists already, none. No rows: no files."""
    register(lines.sparkSession)
    rows = lines.select(F.col("name").cast("string").alias("name"), F.col("n").cast("long").alias("n"), F.col("line").cast("string").alias("line")).where("name is not null")
    rows.repartition("name").sortWithinPartitions("name", "n").write.format("sanitised").option("key", key).option("extension", extension).mode("append").save(path)
