"""Groups of linked records: components, evidence of a group, and the preferred record."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_folder(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; where it is unset a temporary folder, but only on a local master."""
    if spark.sparkContext.getCheckpointDir():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="kindred-")
    spark.sparkContext.setCheckpointDir(base)


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder, deleted when the driver ends. Its size is known, whereas that of a checkpoint is a guess that grows with each join."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(pairs: DataFrame) -> DataFrame:
    """file_id, group_id (smallest id) of all records in ``pairs`` (left_id, right_id).

    Each round points a record at the smallest of itself and its neighbours, then
    at where that one points, twice as far in each step, until all point at one
    that points at itself. Records that point at the same one become one, so the
    pairs left for the next round are those between different ones, of which
    there are half as many at most. Rounds are cut by tables in the folder of
    ``spark.checkpoint.dir``.
    """
    checkpoint_folder(pairs.sparkSession)

    def tidy(a: str, b: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    edges = _written(tidy("left_id", "right_id", pairs.where("left_id is not null and right_id is not null")))
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, moved = _written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up"))), True
        while moved:
            beyond = up.select(F.col("a").alias("up"), F.col("up").alias("next"))
            now = _written(up.join(beyond, "up").select("a", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
            up, moved = now.select("a", "up"), not now.where("moved").isEmpty()
        rounds.append(up)
        left, right = up.select("a", F.col("up").alias("left")), up.select(F.col("a").alias("b"), F.col("up").alias("right"))
        edges = _written(tidy("left", "right", edges.join(left, "a").join(right, "b").where("left <> right")))
    labels = rounds.pop()
    for up in reversed(rounds):
        labels = up.join(labels.select(F.col("a").alias("up"), F.col("up").alias("label")), "up", "left").select("a", F.coalesce("label", "up").alias("up"))
    return labels.select(F.col("a").alias("file_id"), F.col("up").alias("group_id"))


def member_pairs(members: DataFrame) -> DataFrame:
    """All pairs of a group: its status needs evidence of each of them. Other columns of the members begin with l_ and r_."""
    others = [c for c in members.columns if c not in ("group_id", "file_id")]
    side = lambda p, key: members.select("group_id", F.col("file_id").alias(key), *(F.col(c).alias(p + c) for c in others))
    return side("l_", "left_id").join(side("r_", "right_id"), "group_id").where("left_id < right_id")


def group_status(evidence: DataFrame) -> DataFrame:
    """status and confidence (the least of a group's pairs) from classified pairs."""
    doubt = F.bool_or(F.col("classification").isin("DIFFERENT", "CONFLICT", "PROBABLE"))
    return evidence.groupBy("group_id").agg(F.when(doubt, "REVIEW_REQUIRED").otherwise("AUTO_CONFIRMED").alias("status"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"))


def zero_filled(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """value, n for each of ``values``, those that no row has included."""
    every = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias("value"))
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return every.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def preferred(members: DataFrame, order: list[Column]) -> DataFrame:
    """The first record of each group in ``order``; ties go to the smallest id."""
    w = Window.partitionBy("group_id").orderBy(*order, F.col("file_id"))
    return members.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("group_id", F.col("file_id").alias("preferred_file_id"))
