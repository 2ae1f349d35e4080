"""Writing intermediate tables to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset one is made and set, on a single machine only: on a
    cluster a folder of this machine would be another one for each executor."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="prismlake-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: Rows of narrow tables that are worth a task, and the tasks that any table may have.
ROWS_A_TASK, LEAST_TASKS = 20_000, 12


def staged(df: DataFrame, name: str, rows: int | None = None, codec: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost
    executor costs no recomputation of what stands before. rows: a known bound on its rows, for tables of
    which a few rows only may be left, so that they are not dealt over many empty tasks and files."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, -(-rows // ROWS_A_TASK)))
    path = f"{shared_dir(spark)}/prismlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that is no longer read."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, name)


def remove(spark: SparkSession, name: str) -> None:
    """Deletes a folder of staged files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(path: str):
    """(pyarrow's file system, path in it) of a folder that tasks open themselves."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query has shuffled is deleted as soon as its result is written, not when the driver happens to
    collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (id, component), component being the least id in it.

    Alternates large-star and small-star steps; every step is a grouped minimum (partially aggregated
    before its shuffle) and a join, so one component with most of the nodes stays spread over tasks.
    Links to lower ids only are kept between rounds and each round's table is written to the shared
    folder. Ends when every node that has a lower neighbour has one only, and that has none.
    """
    spark = edges.sparkSession
    links = staged(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "links"
    )
    n = links.count()
    if not n:
        return spark.createDataFrame([], "id long, component long")
    for _ in range(max_rounds):
        # large star: each node's higher neighbours go to its least neighbour (or itself)
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # the minima are written first, so that the join below stands on two plain exchanges, which
        # adaptive execution can split where one node has most of the links
        least = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), (F.count("*") > 1).alias("many")), "least", 2 * n)
        # stars already: no node that has a least neighbour below it has another neighbour, and vice versa
        if least.where("m < u and many").isEmpty():
            break
        large = staged(both.where("v > u").join(least.select("u", "m"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large", n)
        # small star: each node's lower neighbours, and itself, go to its least neighbour
        low = staged(large.groupBy("hi").agg(F.min("lo").alias("m")), "low", n)
        small = large.join(low, "hi")
        links = staged(
            small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(low.select("hi", F.col("m").alias("lo"))).distinct(), "links", 2 * n
        )
    else:
        raise RuntimeError(f"components: not connected after {max_rounds} rounds")
    return links.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "id").unionAll(links.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
