"""Checks of a catalogue: each is a name, whether it passed, and what was found."""

from __future__ import annotations

import os
import shutil
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tools that a scan needs.
EXECUTABLES = ("exiftool", "ffprobe", "fpcalc")


@dataclass(frozen=True)
class Check:
    name: str
    ok: bool
    detail: str = ""


def root_exists(root: Path) -> Check:
    return Check("music_root_exists", root.is_dir(), str(root))


def root_read_only(root: Path) -> Check:
    """The library must not be writable for the process that reads it."""
    return Check("music_root_read_only", root.is_dir() and not os.access(root, os.W_OK), str(root))


def data_writable(root: Path) -> Check:
    try:
        with tempfile.TemporaryFile(dir=root):
            return Check("data_root_writable", True, str(root))
    except OSError as e:
        return Check("data_root_writable", False, str(e))


def executables(names: tuple[str, ...] = EXECUTABLES) -> list[Check]:
    return [Check(f"executable_{n}", shutil.which(n) is not None, shutil.which(n) or "not found") for n in names]


def schema_current(table: DataFrame, expected: str) -> Check:
    """Whether a stored table has the columns that this version writes."""
    want = table.sparkSession.createDataFrame([], expected).schema
    have = {(f.name, f.dataType) for f in table.schema}
    lost = sorted(f.name for f in want if (f.name, f.dataType) not in have)
    return Check("schema_current", not lost, ", ".join(lost))


def sequence_matches(events: DataFrame, watermark: int) -> Check:
    top = events.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    return Check("curation_sequence", top == watermark, f"journal {watermark}, catalogue {top}")


def _none(name: str, bad: DataFrame, column: str) -> Check:
    some = [str(r[0]) for r in bad.select(column).limit(5).collect()]
    return Check(name, not some, ", ".join(some))


def one_active_link(links: DataFrame) -> Check:
    """Names up to five records with several active tracks."""
    return _none("one_active_track", links.where("is_active").groupBy("file_id").count().where("count > 1"), "file_id")


def preferred_exists(tracks: DataFrame, files: DataFrame) -> Check:
    wanted = tracks.where("preferred_file_id is not null")
    return _none("preferred_exists", wanted.join(files.select(F.col("file_id").alias("preferred_file_id")), "preferred_file_id", "left_anti"), "preferred_file_id")
