"""Shared plumbing: cutting lineage in the shared folder, connected components, Arrow batch size."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python. Texts can be long, so the default of 10,000 is too many.
ARROW_ROWS = 512

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="siteloom-"))
        atexit.register(shutil.rmtree, _LOCAL_DIR[0], True)
    return f"file://{_LOCAL_DIR[0]}"


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` if it is larger."""
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """The session's Arrow batch size for a while; what runs within the block has it."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that nothing refers to any more: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables written to the shared folder for the time of one operator.

    ``cut`` writes a frame and reads it back, so that lost executors cost one stage and not the
    whole lineage. Leaving the ``with`` block deletes what ``cut`` wrote; ``keep`` writes a
    frame that outlives it, until the session's end: both are marked to be deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label, self.paths = spark, label, []

    def __enter__(self) -> Scratch:
        return self

    def _write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{shared_dir(self.spark)}/siteloom/{self.label}-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        system, where = self._place(path)
        system.deleteOnExit(where)
        return self.spark.read.schema(df.schema).parquet(path), path

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        out, path = self._write(df, name)
        self.paths.append(path)
        return out

    def keep(self, df: DataFrame, name: str = "out") -> DataFrame:
        return self._write(df, name)[0]

    def _place(self, path: str) -> tuple:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(conf), where

    def drop(self, path: str) -> None:
        system, where = self._place(path)
        system.delete(where, True)

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            self.drop(path)
        self.paths.clear()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b) as (node, component), component = smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each round takes the
    smallest neighbour by a partially aggregated ``min`` and joins it back: one narrow row for each node on one side, so that
    Spark splits the other where a hub's edges are many (adaptive skew join); no list of neighbours is ever made. Rounds go on until nothing changes,
    their number grows with the logarithm of the nodes. Nodes without an edge are not returned; null ends, loops and repeated edges are ignored.
    """
    e = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = scratch.cut(e, "cc")
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u moves to u's smallest neighbour
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, move to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (
            e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = scratch.cut(e, "cc")
        after = state(e)
        if after == before:
            break
        before = after
    star = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return star.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
