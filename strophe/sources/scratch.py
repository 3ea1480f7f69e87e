"""Written tables that cut lineage, and what is iterated over them."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder takes its place if the master is local
    (tests); on a cluster that is an error, as executors couldn't see it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strophe-"))
        found = sc.getCheckpointDir()
    return found


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside hands rows to Python in batches of ``rows``, which bounds the memory of long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Tables:
    """Written tables that cut lineage; ``drop`` deletes one that is used up."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.clear)  # what results may still read goes when the driver ends

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._strophe_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in frames:
            self.delete(df._strophe_path)
        # shuffle files of finished steps go as soon as their plans are collected
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        """Delete all tables of this run, if the session is still up."""
        if self.spark.sparkContext._jsc is not None:
            self.delete(self.base)

    def delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """Connected components of ``edges(u, v)``: ``(node, component)``.

    The component is the smallest node. Labels spread along edges and jump to
    the label of their label, so that rounds grow with the logarithm of the
    longest path. Every step is a join or a min with map-side combining, so a
    hub's edges are never gathered in one task. Without edges: no rows.
    """
    both = tables.write(edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select("v", "u")).toDF("u", "v").distinct())
    now = tables.write(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("changed")))
    while not now.where("changed").isEmpty():
        near = both.join(now.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        spread = now.select("node", F.col("label").alias("old")).join(near, "node", "left").select("node", "old", F.least("old", F.coalesce("m", "old")).alias("label"))
        spread = tables.write(spread)
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = tables.write(spread.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), (F.least("label", F.coalesce("far", "label")) < F.col("old")).alias("changed")))
        tables.drop(spread, now)
        now = after
    tables.drop(both)
    return now.select("node", F.col("label").alias("component"))
