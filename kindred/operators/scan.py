"""Differences of two snapshots and what they mean for stored analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(known: DataFrame, found: DataFrame) -> DataFrame:
    """relative_path, change: NEW, MISSING, UNCHANGED or CHANGED (by size and modification time)."""
    old = known.select("relative_path", F.struct("size_bytes", "mtime_ns").alias("old"))
    new = found.select("relative_path", F.struct("size_bytes", "mtime_ns").alias("new"))
    change = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "MISSING").when(F.col("old") == F.col("new"), "UNCHANGED").otherwise("CHANGED")
    return new.join(old, "relative_path", "full_outer").select("relative_path", "old", "new", change.alias("change"))


def with_analysis_status(changes: DataFrame) -> DataFrame:
    status = F.when(F.col("change") == "CHANGED", "STALE").when(F.col("change") == "NEW", "PENDING").otherwise("CURRENT")
    return changes.withColumn("analysis_status", status)
