"""Where results go: tables as CSV, a model card as text, a manifest of what was made."""

from __future__ import annotations

import platform

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions import titles


def write_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Each table as CSV with a header under folder/name, and the paths. Array columns are joined by blanks."""
    out = []
    for name, table in tables.items():
        plain = [F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c) if t.startswith("array") else F.col(c) for c, t in table.dtypes]
        path = f"{folder.rstrip('/')}/{name}"
        table.select(*plain).write.mode("overwrite").csv(path, header=True)
        out.append(path)
    return out


def is_prototype(spectra: DataFrame) -> bool:
    """Whether any row comes from a source that is marked as a prototype (images)."""
    return "prototype" in spectra.columns and not spectra.where("prototype").isEmpty()


def model_card(summary: DataFrame, title: str, notes: list[str] | None = None, prototype: bool = False) -> DataFrame:
    """One row of Markdown: a table of key and value, and notes. summary: key, value."""
    lines = F.array_sort(F.collect_list(F.concat(F.lit("| "), "key", F.lit(" | "), F.when(F.col("value").isNotNull(), F.format_string("%.6g", "value")).otherwise("n/a"), F.lit(" |"))))
    head = [f"# {title}", ""] + (["**Prototype: from images, not validated.**", ""] if prototype else []) + ["| figure | value |", "|-|-|"]
    tail = ["", *(f"- {n}" for n in notes or [])]
    return summary.agg(F.concat_ws("\n", F.lit("\n".join(head)), F.array_join(lines, "\n"), F.lit("\n".join(tail))).alias("markdown"))


def append_block(card: DataFrame, title: str, rows: DataFrame, note: str | None = None) -> DataFrame:
    """card (markdown) with a further block: a table of all columns of rows, in the order of the first ones, numbers
    to six digits, nulls and NaN as n/a. Rows are those of a table of results, few."""
    cells = [F.coalesce(F.when(F.col(c).isNotNull() & ~F.isnan(c), F.format_string("%.6g", c)) if t in ("double", "float") else F.col(c).cast("string"), F.lit("n/a")) for c, t in rows.dtypes]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = f"\n\n## {title}\n\n| {' | '.join(rows.columns)} |\n|{'-|' * len(rows.columns)}\n"
    table = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(rows.columns)), line.alias("line")))), lambda s: s["line"]), "\n").alias("_t"))
    return card.crossJoin(table).select(F.concat("markdown", F.lit(head), "_t", F.lit(f"\n\n{note}" if note else "")).alias("markdown"))


def regression_block(card: DataFrame, metrics: DataFrame, merit: DataFrame | None = None) -> DataFrame:
    """card with the figures of a regression and, if given, its analytical figures of merit."""
    out = append_block(card, "Regression", metrics, "RPD is the deviation of the references over SEP, RER their range over SEP.")
    return out if merit is None else append_block(out, "Figures of merit", merit, "Limits of detection and quantification are 3.3 and 10 times the noise over the sensitivity.")


def manifest(spark: SparkSession, model: DataFrame, classes: list[str], channels: int) -> DataFrame:
    """One row: versions, the model's checksum, its classes and channels. model: the one row that holds it as
    `model`."""
    return model.select(
        F.to_json(F.struct(F.lit(spark.version).alias("spark"), F.lit(pyspark.__version__).alias("pyspark"), F.lit(np.__version__).alias("numpy"), F.lit(platform.python_version()).alias("python"),
                           F.sha2("model", 256).alias("sha256"), F.lit(classes).alias("classes"), F.lit(channels).alias("channels"))).alias("manifest")
    )


def output_name(label: str, seed: int, fingerprint: str) -> str:
    """A folder name for a run: a slug of its label, its seed and the start of its fingerprint."""
    slug = "-".join("".join(c if c.isalnum() else " " for c in label.lower()).split())
    return f"{slug or 'run'}-s{seed}-{fingerprint[:8]}"


def metrics_of(summary_text: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """The numbers of a written summary, read back: a column for each name."""
    return summary_text.select(*(titles.metric_in(F.col(text), n).alias(n) for n in names))
