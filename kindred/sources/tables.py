"""Files of a tree as a table, and tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """relative_path, size_bytes, mtime_ns of the files with one of the suffixes; contents are not read.

    Times are as fine as Spark's timestamps, that is microseconds.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/")
    at = F.instr("path", F.lit(base + "/"))
    relative = F.substring(F.col("path"), at + len(base) + 1, F.length("path"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(suffix.isin(*suffixes)).select(relative.alias("relative_path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def write_csv(rows: DataFrame, path: str, order_by: list[str]) -> None:
    """With a header; booleans as True and False, null as an empty field."""
    out = rows.orderBy(*order_by)
    for f in rows.schema:
        if isinstance(f.dataType, T.BooleanType):
            out = out.withColumn(f.name, F.initcap(F.col(f.name).cast("string")))
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
