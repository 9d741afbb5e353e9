"""Overrides in an ordered journal. A null value is a decision too, so its absence is told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ("artist", "title", "version", "edition")


def override_history(events: DataFrame) -> DataFrame:
    """Each override with the sequence of the one that replaced it."""
    w = Window.partitionBy("track", "field").orderBy("seq")
    return events.where(F.col("field").isNotNull()).select("seq", "track", "field", "value", F.lead("seq").over(w).alias("superseded_by"))


def active_overrides(events: DataFrame) -> DataFrame:
    """track, and for each field a struct with the value of its last override, or null where there is none."""
    last = events.where(F.col("field").isNotNull()).groupBy("track", "field").agg(F.max_by(F.struct("value"), "seq").alias("now"))
    return last.groupBy("track").agg(*(F.max(F.when(F.col("field") == f, F.col("now"))).alias(f) for f in FIELDS))


def effective_identity(tracks: DataFrame, events: DataFrame) -> DataFrame:
    """``tracks`` (track, artist, title, version, edition, ..) with the last override of each field laid over, also where that is null."""
    over = active_overrides(events).select("track", F.struct(*FIELDS).alias("_over"))
    out = tracks.join(over, "track", "left")
    return out.withColumns({f: F.when(F.col("_over")[f].isNotNull(), F.col("_over")[f]["value"]).otherwise(F.col(f)) for f in FIELDS}).drop("_over")
