"""Copies of the journal that follow it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kindred.sources import journal_file


def follow(spark: SparkSession, journal: str, target: str, checkpoint: str) -> None:
    """Appends what ``journal`` has got since the last call to the JSON lines at ``target``, and ends.

    The checkpoint is the watermark: files are taken whole and once, also after a
    call that was cut off, and a call without new files adds nothing.
    """
    query = journal_file.stream(spark, journal).writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
