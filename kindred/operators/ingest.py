"""A scan as one call: new, changed and missing files, their metadata, tracks and counters.

The catalogue's tables are joined once with what was found; every row is decided
in place and nothing is gathered on the driver but the counters. A file whose
metadata could not be read keeps what it had and is counted as failed; it does not
stop the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import scan
from kindred.operators.resolve import featured_rows, public_id, resolved

IDENTITY = ("artist", "title", "version", "edition")
ANALYSES = ("binary_hash_status", "chromaprint_status", "quality_status")
#: What a reader of metadata gives for a file; ``error`` says why it could not.
METADATA = ("container_format", "codec", "bitrate", "sample_rate", "bit_depth", "channels", "duration_ms", "title_raw", "artist_raw", "album_raw", "genre_raw", "bpm_raw", "key_raw")
TYPES = {"bitrate": "bigint", "sample_rate": "bigint", "bit_depth": "bigint", "channels": "bigint", "duration_ms": "bigint"}
FEATURED = "array<struct<position:int,name:string,source:string>>"


@dataclass
class Scan:
    files: DataFrame
    featured: DataFrame
    tracks: DataFrame
    links: DataFrame
    changes: DataFrame


def to_read(known: DataFrame, found: DataFrame, full: bool = False) -> DataFrame:
    """relative_path and change of the files whose metadata must be read: new and changed ones, or all."""
    wanted = ("NEW", "CHANGED", "UNCHANGED") if full else ("NEW", "CHANGED")
    return scan.diff(known, found).where(F.col("change").isin(*wanted)).select("relative_path", "change")


def analysis_is_current(status: Column, value: Column, version: Column | None = None, current: str | None = None) -> Column:
    """Whether a stored analysis can be used: its status, a value, and where there is one, the analyser's version."""
    ok = F.coalesce(status == "CURRENT", F.lit(False)) & value.isNotNull()
    return ok if version is None else ok & F.coalesce(version == current, F.lit(False))


def apply(known: DataFrame, found: DataFrame, metadata: DataFrame, tracks: DataFrame, links: DataFrame, now: Column, full: bool = False) -> Scan:
    """The catalogue after a scan.

    known: file_id, relative_path, size_bytes, mtime_ns, is_present, first_seen_at,
    last_seen_at, METADATA, ``resolved_*``, ``*_source``, featured and ANALYSES.
    found: relative_path, size_bytes, mtime_ns. metadata: relative_path, METADATA and
    error, for the files of ``to_read``. tracks: track_id, status, IDENTITY,
    preferred_file_id, merged_into, featured. links: file_id, track_id, relationship,
    decision_source, is_active.
    """
    changes = scan.diff(known, found)
    read = resolved(metadata.where("error is null").select("relative_path", *METADATA))
    fresh = [*METADATA, *(f"resolved_{f}" for f in IDENTITY), *(f"{f}_source" for f in IDENTITY), "featured"]
    rows = changes.join(known.drop("size_bytes", "mtime_ns"), "relative_path", "left")
    rows = rows.join(read.select("relative_path", F.struct(*fresh).alias("read")), "relative_path", "left")
    rows = rows.join(metadata.where("error is not null").select("relative_path", F.lit(True).alias("failed")), "relative_path", "left")
    seen, is_new = F.col("new").isNotNull(), F.col("change") == "NEW"
    due = is_new | (F.col("change") == "CHANGED") | (F.lit(full) & seen)
    got = due & F.col("read").isNotNull()
    stale = due & ~is_new
    size = F.coalesce("new", "old")
    files = rows.select(
        F.coalesce("file_id", public_id("fil", F.col("relative_path"))).alias("file_id"),
        "relative_path",
        size.size_bytes.alias("size_bytes"),
        size.mtime_ns.alias("mtime_ns"),
        seen.alias("is_present"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        *(F.when(got, F.col("read")[c]).otherwise(F.col(c)).alias(c) for c in fresh),
        *(F.when(is_new, "PENDING").when(stale, "STALE").otherwise(F.col(a)).alias(a) for a in ANALYSES),
        "change",
        got.alias("_got"),
        (due & F.coalesce("failed", F.lit(False))).alias("failed"),
    )
    # A file has one track from the moment it is seen, whether its metadata could be read or not.
    mine = links.where("is_active").select("file_id", F.col("track_id").alias("_track"))
    owned = files.join(mine, "file_id", "left")
    homeless = owned.where(F.col("_track").isNull() & ((F.col("change") == "NEW") | F.col("_got")))
    identity = [F.col(f"resolved_{f}").alias(f) for f in IDENTITY]
    track = public_id("trk", F.col("relative_path"))
    none = F.lit(None).cast("string")
    created = homeless.select(track.alias("track_id"), F.lit("PROVISIONAL").alias("status"), *identity, none.alias("preferred_file_id"), none.alias("merged_into"), F.coalesce("featured", F.array().cast(FEATURED)).alias("featured"))
    new_links = homeless.select("file_id", track.alias("track_id"), F.lit("PRIMARY").alias("relationship"), F.lit("AUTOMATIC").alias("decision_source"), F.lit(True).alias("is_active"))
    # Of several re-read files of a track the last by path gives its identity.
    again = owned.where(F.col("_track").isNotNull() & F.col("_got")).groupBy(F.col("_track").alias("track_id")).agg(F.max_by(F.struct(*identity, F.col("featured").alias("featured")), "relative_path").alias("_new"))
    kept = tracks.join(again, "track_id", "left")
    refreshed = kept.withColumns({c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in (*IDENTITY, "featured")}).drop("_new")
    return Scan(files.drop("change", "failed", "_got"), featured_rows(files.where("featured is not null"), "file_id"), refreshed.unionByName(created), links.unionByName(new_links), files.select("relative_path", "change", "failed"))


def counters(changes: DataFrame) -> DataFrame:
    """One row: files seen, new, changed, unchanged, missing and failed, the status, and the first 20 failed paths."""
    count = lambda c: F.count_if(F.col("change") == c)
    one = changes.agg(F.count_if(F.col("change") != "MISSING").alias("files_seen"), *(count(c).alias(f"files_{c.lower()}") for c in ("NEW", "CHANGED", "UNCHANGED", "MISSING")), F.count_if("failed").alias("files_failed"))
    paths = [r[0] for r in changes.where("failed").select("relative_path").orderBy("relative_path").limit(21).collect()]
    summary = F.lit(", ".join(paths[:20]) + (", ..." if len(paths) > 20 else "") if paths else None).cast("string")
    status = F.when(F.col("files_failed") > 0, "SUCCESS_WITH_ERRORS").otherwise("SUCCESS")
    return one.select("*", status.alias("status"), summary.alias("error_summary"))


def run_record(changes: DataFrame, run_id: str, started: Column, ended: Column, version: str) -> DataFrame:
    """The record of a scan, one row."""
    return counters(changes).select(F.lit(run_id).alias("public_id"), started.alias("started_at"), ended.alias("ended_at"), "status", *(f"files_{c}" for c in ("seen", "new", "changed", "unchanged", "missing", "failed")), F.lit(version).alias("scanner_version"), "error_summary")


def normalized(tracks: DataFrame) -> DataFrame:
    """``tracks`` with the normal form of each part of the identity, by which candidates are found."""
    return tracks.withColumns({f"{f}_normalized": text.normalize_identity(F.col(f)) for f in IDENTITY})
