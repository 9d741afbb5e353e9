"""What external tools say about a record: running them, and reading their output with expressions."""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Runner = Callable[[list[str]], tuple[int, str, str]]

# Fixed values ---------------------------------------------------------------------------
TAGS = {"title": "Title", "artist": "Artist", "album": "Album", "album_artist": "AlbumArtist", "genre": "Genre", "bpm": "BPM", "key": "InitialKey", "comment": "Comment"}
TAG_COMMAND = ["exiftool", "-j", "-n", *(f"-{t}" for t in TAGS.values())]
PROBE_COMMAND = ["ffprobe", "-v", "error", "-print_format", "json", "-show_format", "-show_streams"]
LEVEL_LINE = r"(?m)^\[Parsed_astats[^\]]*\]\s*([^:\n]+):\s*(.+)$"
# ----------------------------------------------------------------------------------------
PROBE = """struct<format: struct<format_name: string, duration: string, bit_rate: string>, streams: array<struct<
codec_type: string, codec_name: string, duration: string, bit_rate: string, sample_rate: string, bits_per_sample: string, bits_per_raw_sample: string, channels: string>>>"""
RESULT = "exit_code int, stdout string, stderr string, error string"


def run_command(argv: list[str]) -> tuple[int, str, str]:
    """Bytes that are not UTF-8 are replaced; a failing command is not an error here."""
    done = subprocess.run(argv, capture_output=True, check=False)
    return done.returncode, done.stdout.decode("utf-8", "replace"), done.stderr.decode("utf-8", "replace")


def with_command(files: DataFrame, argv: Callable[[str], list[str]], runner: Runner = run_command, path: str = "path") -> DataFrame:
    """``files`` with exit_code, stdout, stderr; what the runner raises is in error, and other rows go on."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for p in rows[path]:
                try:
                    out.append((*runner(argv(p)), None))
                except Exception as e:  # noqa: BLE001 (kept with the row)
                    out.append((None, None, None, f"{type(e).__name__}: {e}"))
            new = pd.DataFrame(out, columns=["exit_code", "stdout", "stderr", "error"], index=rows.index)
            new["exit_code"] = new["exit_code"].astype("Int32")
            yield pd.concat([rows, new], axis=1)

    schema = T.StructType([*files.schema, *T.StructType.fromDDL(RESULT)])
    return files.mapInPandas(call, schema)


def optional_int(c: Column) -> Column:
    """Text as a truncated integer; null and 0 without a fraction are unknown."""
    return F.when(c != "0", c.try_cast("double").cast("long"))


def milliseconds(seconds: Column) -> Column:
    """Half goes to the even neighbour."""
    return F.bround(seconds.try_cast("double") * 1000).cast("long")


def _either(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)


def read_probe(out: Column) -> Column:
    """Struct of technical fields from the JSON of a probe; error tells why there are none."""
    parsed = F.from_json(out, PROBE)
    audio = F.get(F.filter(parsed["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    fmt = parsed["format"]
    depth = F.when(F.coalesce(audio["bits_per_sample"], F.lit("0")).isin("", "0"), audio["bits_per_raw_sample"]).otherwise(audio["bits_per_sample"])
    length = milliseconds(_either(fmt["duration"], audio["duration"]))
    error = F.when(F.try_parse_json(out).isNull(), "invalid JSON").when(audio.isNull(), "no audio stream").when(length.isNull(), "no duration")
    return F.struct(
        fmt["format_name"].alias("container_format"),
        audio["codec_name"].alias("codec"),
        optional_int(_either(fmt["bit_rate"], audio["bit_rate"])).alias("bitrate"),
        optional_int(audio["sample_rate"]).alias("sample_rate"),
        optional_int(depth).alias("bit_depth"),
        optional_int(audio["channels"]).alias("channels"),
        length.alias("duration_ms"),
        error.alias("error"),
    )


def read_tags(out: Column) -> Column:
    """Struct of raw tags from the first record of a tag reader's JSON, any value as text."""
    first = F.get(F.from_json(out, "array<map<string,string>>"), F.lit(0))
    return F.struct(*(F.try_element_at(first, F.lit(t)).alias(n) for n, t in TAGS.items()), F.when(first.isNull(), "no metadata").alias("error"))


def level(err: Column, key: str) -> Column:
    """The last value of a level statistic as a number, or null."""
    pairs = F.arrays_zip(F.regexp_extract_all(err, F.lit(LEVEL_LINE), F.lit(1)).alias("k"), F.regexp_extract_all(err, F.lit(LEVEL_LINE), F.lit(2)).alias("v"))
    mine = F.filter(pairs, lambda p: F.trim(p["k"]) == key)
    return F.trim(F.try_element_at(mine, F.lit(-1))["v"]).try_cast("double")


def is_clipped(err: Column, peak_db: float = -0.5, share: float = 0.10) -> Column:
    """Whether the peak is near full scale and often reached; unknown is false."""
    n = F.nullif(level(err, "Number of samples"), F.lit(0.0))
    return F.coalesce((level(err, "Peak level dB") > peak_db) & (level(err, "Abs Peak count") / n > share), F.lit(False))


def attenuation(reference_err: Column, high_band_err: Column) -> Column:
    return level(reference_err, "RMS level dB") - level(high_band_err, "RMS level dB")


def is_intact(exit_code: Column, err: Column) -> Column:
    return (exit_code == 0) & (F.trim(F.coalesce(err, F.lit(""))) == "")


def fingerprint_command(path: str) -> list[str]:
    return ["fpcalc", "-json", path]


def read_fingerprint(out: Column) -> Column:
    """struct(fingerprint, duration_ms, error) from the tool's JSON."""
    parsed = F.from_json(out, "struct<fingerprint:string,duration:double>")
    good = parsed["fingerprint"].isNotNull() & parsed["duration"].isNotNull()
    return F.struct(F.when(good, parsed["fingerprint"]).alias("fingerprint"), F.when(good, F.round(parsed["duration"] * 1000).cast("long")).alias("duration_ms"), F.when(~F.coalesce(good, F.lit(False)), "no fingerprint").alias("error"))


def decode_command(path: str) -> list[str]:
    """Decodes all of a file; what it says tells whether the file is intact."""
    return ["ffmpeg", "-v", "error", "-i", path, "-f", "null", "-"]


def level_command(path: str, audio_filter: str = "astats") -> list[str]:
    """Level statistics of a file, or of what a filter leaves of it."""
    return ["ffmpeg", "-hide_banner", "-v", "info", "-i", path, "-af", audio_filter, "-f", "null", "-"]


CHUNK = 1 << 20


def file_digest(path: str) -> str | None:
    """SHA-256 of a file, a chunk at a time; null if it cannot be read."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while part := f.read(CHUNK):
                digest.update(part)
    except OSError:
        return None
    return digest.hexdigest()


def with_digests(files: DataFrame, root: str) -> DataFrame:
    """``files`` (relative_path, binary_hash, binary_hash_status, ..) with current digests.

    Only files whose digest is not current are read; a file that cannot be read
    has none, and the status FAILED. ``root`` must be readable for executors.
    """

    @F.pandas_udf("string")
    def digests(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: file_digest(f"{root}/{p}"), na_action="ignore")

    current = F.coalesce((F.col("binary_hash_status") == "CURRENT") & F.col("binary_hash").isNotNull(), F.lit(False))
    done, due = files.where(current), files.where(~current)
    due = due.withColumn("binary_hash", digests("relative_path"))
    return done.unionByName(due.withColumn("binary_hash_status", F.when(F.col("binary_hash").isNull(), "FAILED").otherwise("CURRENT")))
