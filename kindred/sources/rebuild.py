"""Snapshots of a catalogue that are made anew from a scan and the journal."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from kindred.operators import replay
from kindred.operators.health import Check
from kindred.sources import journal_file


class RebuildError(RuntimeError):
    pass


def rebuild(spark: SparkSession, links: DataFrame, journal: str, root: str, checks: list[Check], now: datetime) -> str:
    """Writes a new snapshot below ``root`` and returns its folder; older ones stay as backups.

    ``links`` (relative_path, track_id) come from a full scan. Nothing is written
    where a check has failed or an event cannot be applied. The snapshot counts as
    complete once all its tables have their success marks; ``done`` is the last.
    """
    failed = [c.name for c in checks if not c.ok]
    if failed:
        raise RebuildError(f"failed checks: {', '.join(failed)}")
    out = replay.replay(links, journal_file.read(spark, journal))
    base = f"{root.rstrip('/')}/snapshot-{now:%Y%m%d-%H%M%S-%f}"
    for name in ("links", "tracks", "overrides", "groups"):
        getattr(out, name).write.parquet(f"{base}/{name}")
    out.counts.write.parquet(f"{base}/done")
    return base
