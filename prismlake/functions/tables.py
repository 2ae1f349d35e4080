"""Cutting the lineage of a table that is read again and again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="prismlake-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder of the session (spark.checkpoint.dir) and read from there. Where it is
    unset one is made, on a single machine only: on a cluster it would be another folder for each executor."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As stored, but as Parquet, which `deleted` takes away again when another step has replaced it."""
    path = f"{_folder(df)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Deletes the files of a written table that is no longer read."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
