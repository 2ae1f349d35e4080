"""A folder of spectra as one table: titles, side tables, dominant range, common grid; what a load would
drop, from the headers alone; and copies without provenance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismlake.functions import titles
from prismlake.operators import quality
from prismlake.sources import datasource
from prismlake.sources.readers import read_spectra


def resolve_titles(rows: DataFrame, names: DataFrame | None = None, corrections: DataFrame | None = None, aliases: DataFrame | None = None, exclusions: DataFrame | None = None, title: str = "title") -> DataFrame:
    """rows with code, label, date, adulterant, content, replicate, valid, group_id, excluded.

    corrections (title, code, date, adulterant, content, replicate) go before the pattern and match exactly;
    names (code, name) label codes, an unknown code labels itself; aliases (source, target) rename groups;
    exclusions (title, reason) give the reason in `excluded`. All tables are optional and small (a row for
    each thing that somebody wrote by hand); Spark chooses how to join them."""
    fields = ("code", "date", "adulterant", "content", "replicate")
    t = titles.parse_title(F.col(title))
    out = rows.withColumns({k: t[k] for k in (*fields, "valid", "group_id")}).withColumn("_t", F.trim(F.col(title)))
    if corrections is not None:
        c = corrections.select(F.trim("title").alias("_c"), *(F.col(k).alias(f"_{k}") for k in fields)).dropDuplicates(["_c"])
        out = out.join(c, out["_t"] == c["_c"], "left")
        known = F.col("_c").isNotNull()
        key = F.concat_ws("-", "_code", "_date", F.when(F.col("_adulterant").isNotNull(), F.concat("_adulterant", F.format_string("%.2f", F.col("_content").cast("double")))))
        out = out.withColumns({k: F.when(known, F.col(f"_{k}")).otherwise(F.col(k)) for k in fields} | {"group_id": F.when(known, key).otherwise(F.col("group_id")), "valid": known | F.col("valid")}).drop("_c", *(f"_{k}" for k in fields))
    if aliases is not None:
        a = aliases.select(F.col("source").alias("_s"), F.col("target").alias("_g")).dropDuplicates(["_s"])
        out = out.join(a, out["group_id"] == a["_s"], "left").withColumn("group_id", F.coalesce("_g", "group_id")).drop("_s", "_g")
    out = out.withColumn("label", F.col("code"))
    if names is not None:
        n = names.select(F.col("code").alias("_k"), F.col("name").alias("_n")).dropDuplicates(["_k"])
        out = out.join(n, out["code"] == n["_k"], "left").withColumn("label", F.coalesce("_n", "code")).drop("_k", "_n")
    if exclusions is not None:
        x = exclusions.select(F.trim("title").alias("_x"), F.coalesce("reason", F.lit("excluded")).alias("excluded")).dropDuplicates(["_x"])
        return out.join(x, out["_t"] == x["_x"], "left").drop("_x", "_t")
    return out.withColumn("excluded", F.lit(None).cast("string")).drop("_t")


def name_parts(path: Column, part: int = 0) -> Column:
    """The underscore- or hyphen-separated part of a file's name; of fewer parts, the first."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "[_-]")
    return F.coalesce(F.get(parts, F.lit(part)), F.get(parts, F.lit(0)))


def resampled(rows: DataFrame, grid: np.ndarray) -> DataFrame:
    """rows (wn, x) with x on the grid: each row between its own neighbouring abscissae, ends clamped."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for wn, x in zip(b.column(names.index("wn")).to_pylist(), b.column(names.index("x")).to_pylist(), strict=True):
                if not wn or not x:
                    out.append(None)
                    continue
                order = np.argsort(wn)
                out.append(np.interp(grid, np.array(wn)[order], np.array(x)[order]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())) if n == "x" else c for n, c in zip(names, b.columns, strict=True)], names)

    return rows.mapInArrow(run, rows.schema)


def load(spark: SparkSession, folder: str, use_title: bool = True, content_from_name: bool = False, **tables: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(spectra, rejected, grid): every file of a tree, one sub-folder per class.

    spectra: path, title, label, conc, group_id, x on one grid, that of the first file (by path) of the
    dominant range. rejected: path, reason (unreadable, excluded, out of range). Label: from the title if it
    is valid, else the folder. A pure or unread title has conc 0, or what the file's name says. A file
    without a group is a group of its own."""
    files = read_spectra(spark, folder)
    good = resolve_titles(files.where("error is null"), **tables)
    ranged = quality.dominant_range(good.withColumn("x_max", F.array_max("wn")))
    kept = ranged.where("kept and excluded is null")
    first = kept.orderBy("path").select("wn").first()
    grid = np.array(first["wn"]) if first else np.zeros(0)
    from_name = F.coalesce(titles.content_from_name(F.element_at(F.split("path", "/"), -1)), F.lit(0.0)) if content_from_name else F.lit(0.0)
    titled = F.col("valid") if use_title else F.lit(False)
    out = kept.select(
        "path", "title", F.when(titled, F.col("label")).otherwise(F.col("folder")).alias("label"),
        F.when(titled & F.col("content").isNotNull(), F.col("content")).otherwise(from_name).alias("conc"),
        F.coalesce(F.when(titled, F.col("group_id")), F.concat(F.lit("orphan_"), F.element_at(F.split("path", "/"), -1))).alias("group_id"), "wn", "x",
    )
    rejected = files.where("error is not null").select("path", F.col("error").alias("reason")).unionByName(ranged.where("excluded is not null").select("path", F.col("excluded").alias("reason"))).unionByName(ranged.where("excluded is null and not kept").select("path", F.lit("out of range").alias("reason")))
    return resampled(out, grid).drop("wn"), rejected, grid


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """path, folder, title, last_x, bytes_read of each .dx file. Only blocks up to the first data are read of a
    file, in a folder on a store that pyarrow.fs knows."""
    datasource.register(spark)
    found = spark.read.format("spectra").schema("path string, folder string, title string, last_x double, bytes_read long").load(folder)
    return found.where(F.lower("path").endswith(".dx"))


def prescan(rows: DataFrame, **tables: DataFrame) -> DataFrame:
    """One row of what a load of files with these headers (folder, title, last_x) would keep: n_files,
    n_no_header, dominant, n_out_of_range, n_kept, n_orphans, n_groups (each orphan is one)."""
    named = resolve_titles(rows, **tables)
    ranged = quality.dominant_range(named.where("last_x is not null"), "last_x")
    kept = F.col("kept")
    counted = ranged.agg(F.max("mode").alias("dominant"), F.count_if(~kept).alias("n_out_of_range"), F.count_if(kept).alias("n_kept"), F.count_if(kept & ~F.col("valid")).alias("n_orphans"), (F.countDistinct(F.when(kept & F.col("valid"), F.col("group_id"))) + F.count_if(kept & ~F.col("valid"))).alias("n_groups"))
    return rows.agg(F.count("*").alias("n_files"), F.count_if(F.col("last_x").isNull()).alias("n_no_header")).crossJoin(counted)


def out_of_range(rows: DataFrame) -> DataFrame:
    """folder, n: files that the dominant range drops, by folder."""
    return quality.dominant_range(rows.where("last_x is not null"), "last_x").where("not kept").groupBy("folder").agg(F.count("*").alias("n"))


def preview(spectra: DataFrame, n: int = 5) -> DataFrame:
    """The first n files of each folder, by path: their paths are ranked, not their spectra."""
    first = spectra.select("folder", "path").withColumn("_r", F.row_number().over(Window.partitionBy("folder").orderBy("path"))).where(F.col("_r") <= n).select("path")
    return spectra.join(first, "path", "left_semi")


#: Labels that name people, places or serial numbers, in normal form, without `##` and `$`.
PROVENANCE = ("AUDITTRAIL", "DETECTORMODEL", "SPECTROMETERMODEL", "ACCESSORYMODEL", "OWNER", "ORIGIN", "OPERATOR", "SOURCEREFERENCE", "SAMPLEDESCRIPTION", "COMMENTS", "PATH", "FILENAME")


def _label(line: Column) -> Column:
    """The label that a line opens, in normal form; null for a line that opens none."""
    head = F.substring_index(F.ltrim(line), "=", 1)
    return F.when(F.ltrim(line).startswith("##"), F.regexp_replace(titles.normal_label(head), r"^##\$?", ""))


def is_provenance(label: Column) -> Column:
    """Whether a label begins like one of PROVENANCE."""
    return F.coalesce(label.rlike("^(" + "|".join(PROVENANCE) + ")"), F.lit(False))


def without_provenance(lines: DataFrame, file: str = "path", at: str = "n", text: str = "line") -> DataFrame:
    """lines without those of provenance labels and without their continuations: a line that opens no label
    belongs to the last one above it, but a blank line ends that. A file's lines are ordered within the file."""
    w = Window.partitionBy(file).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.ltrim(F.col(text)) == "", F.lit("")).otherwise(_label(F.col(text)))
    return lines.withColumn("_label", F.last(opens, ignorenulls=True).over(w)).where(~is_provenance(F.coalesce("_label", F.lit("")))).drop("_label")


def anonymous_titles(lines: DataFrame, file: str = "path", text: str = "line", key: str = "") -> DataFrame:
    """lines with each ##TITLE replaced by a hash of its physical sample and its replicate mark: replicates
    stay together, names go. Codes and dates are few and could be tried out, so give a secret key."""
    title = F.trim(F.regexp_extract(F.col(text), r"(?i)^\s*##TITLE\s*=(.*)$", 1))
    replicate = F.regexp_extract(title, r"[-_]?T_?(\d+)\s*$", 1)
    group = F.trim(F.regexp_replace(title, r"(?i)[-_]?T_?\d+\s*$", ""))
    inner = F.sha2(F.concat(F.lit(key), group), 256)
    digest = F.sha2(F.concat(F.lit(key), inner), 256) if key else inner
    new = F.concat(F.lit("##TITLE=S"), F.substring(digest, 1, 10), F.when(replicate != "", F.concat(F.lit("-T"), replicate)).otherwise(""))
    return lines.withColumn(text, F.when(F.col(text).rlike(r"(?i)^\s*##TITLE\s*="), new).otherwise(F.col(text)))


def sanitise_folder(spark: SparkSession, source: str, target: str, key: str) -> DataFrame:
    """Copies of all .dx files under source as target/<keyed hash of the path>.dx, without provenance and with
    anonymous titles; returns n_files, n_lines, n_dropped.

    A file's lines are ordered within the file; the sink scans what it wrote and publishes all copies or none."""
    files = spark.read.option("encoding", "ISO-8859-1").text(source, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[dD][xX]")
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("n", "line"))
    # a last line break opens no line
    lines = lines.withColumn("_end", F.max("n").over(Window.partitionBy("path"))).where("not (n = _end and line = '')").drop("_end")
    kept = anonymous_titles(without_provenance(lines), key=key)
    datasource.write_sanitised(kept.select(F.col("path").alias("name"), "n", "line"), target, key)
    before, after = lines.agg(F.count("*").alias("b"), F.countDistinct("path").alias("n_files")), kept.agg(F.count("*").alias("n_lines"))
    return before.crossJoin(after).select("n_files", "n_lines", (F.col("b") - F.col("n_lines")).alias("n_dropped"))


def suspicious(lines: DataFrame, file: str = "path", text: str = "line") -> DataFrame:
    """Lines that still look like provenance, found by another rule than the one that removes them."""
    return lines.where(F.col(text).rlike(r"(?i)##\s*\$?\s*(audit|owner|origin|operator|path|filename|(detector|spectrometer|accessory)\s*model)|instrument id|detector id"))
