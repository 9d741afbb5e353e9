"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to Python at a time, about as many as are worked on at a time.
BATCH_ROWS = 512
#: A key with at least one in so many rows is heavy; there cannot be more heavy keys than this.
HEAVY_SHARE = 4096


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder, but only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The path's file system and the path, both of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scratch:
    """Writes tables below ``spark.checkpoint.dir`` and reads them back.

    A table cuts the lineage and outlives lost executors. What is not dropped
    before goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        """A new path in the folder."""
        self._n += 1
        if self._n == 1:
            fs, p = hadoop_path(self.spark, self.root)
            fs.mkdirs(p)
            fs.deleteOnExit(p)
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with few_rows(self.spark):
            writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kindred_path = path
        return out

    def settle(self) -> None:
        """Lets Spark delete the shuffle files of finished steps, which it else keeps until the driver happens to collect its garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            fs, path = hadoop_path(self.spark, t._kindred_path)
            fs.delete(path, True)


class few_rows:
    """Within it, Python gets at most ``BATCH_ROWS`` rows at a time."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.rows = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(min(int(self.rows), BATCH_ROWS)))

    def __exit__(self, *_) -> None:
        self.spark.conf.set(BATCH, self.rows)


def heavy_least(total: int) -> int:
    """Keys with so many of ``total`` rows are heavy. There are ``HEAVY_SHARE`` of them at most, however large the tables are."""
    return max(2, -(-total // HEAVY_SHARE))


def join_split(rows: DataFrame, keyed: DataFrame, key: str, n: Column, total: int) -> DataFrame:
    """Inner join on ``key`` of ``rows`` with ``keyed``, a row a key, where ``n`` (of ``keyed``) says how many of ``rows`` have the key.

    Heavy keys, of which there are few by the bound of ``heavy_least``, are
    broadcast and so meet their rows where these are; the others are joined by
    shuffle, with no key that could fill a task.
    """
    least = heavy_least(total)
    heavy, light = F.broadcast(keyed.where(n >= least)), keyed.where(n < least)
    rest = rows.join(F.broadcast(keyed.where(n >= least).select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light.hint("merge"), key))
