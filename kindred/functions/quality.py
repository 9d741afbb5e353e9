"""Technical quality of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------
LOSSLESS_CODECS = ("flac", "alac", "wavpack", "ape", "tta")
LOSSY_CODECS = ("mp3", "aac", "vorbis", "opus", "ac3", "eac3", "wmav1", "wmav2", "mp2")
LOSSLESS_CONTAINERS = ("wav", "aiff", "flac")
PENALTY = {"NONE": 0.0, "LOW": 8.0, "MEDIUM": 25.0, "HIGH": 55.0}
RANK = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3}
CLIPPING_PENALTY = 8.0
METADATA_BONUS = 3.0
# ----------------------------------------------------------------------------------------


def _lookup(c: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def is_lossless(codec: Column, container: Column) -> Column:
    codec, container = F.lower(F.coalesce(codec, F.lit(""))), F.lower(F.coalesce(container, F.lit("")))
    inside = F.lit(False)
    for name in LOSSLESS_CONTAINERS:
        inside = inside | container.contains(name)
    return F.when(codec.startswith("pcm_") | codec.isin(*LOSSLESS_CODECS), True).when(codec.isin(*LOSSY_CODECS), False).otherwise(inside)


def transcode_suspicion(lossless: Column, sample_rate: Column, attenuation: Column) -> Column:
    """By how much the top band is damped; only for lossless records of 40 kHz or more."""
    known = lossless & (sample_rate >= 40_000) & attenuation.isNotNull()
    return F.when(~F.coalesce(known, F.lit(False)) | (attenuation < 8), "NONE").when(attenuation < 12, "LOW").when(attenuation < 16, "MEDIUM").otherwise("HIGH")


def resolution_score(lossless: Column, sample_rate: Column, bit_depth: Column, bitrate: Column) -> Column:
    """Lossless: the weaker of rate and depth against CD; lossy: by bit rate, at most 90. 0 counts as unknown."""
    rate, depth = F.coalesce(F.nullif(sample_rate, F.lit(0)), F.lit(44_100)), F.coalesce(F.nullif(bit_depth, F.lit(0)), F.lit(16))
    return F.when(lossless, F.lit(100.0) * F.least(F.lit(1.0), rate / 44_100, depth / 16)).otherwise(F.least(F.lit(90.0), F.coalesce(bitrate, F.lit(0)) / 1000.0 / 320.0 * 90.0))


def completeness(*fields: Column) -> Column:
    filled = F.lit(0)
    for f in fields:
        filled = filled + F.when(F.coalesce(f, F.lit("")) != "", 1).otherwise(0)
    return filled / len(fields)


def composite_score(resolution: Column, suspicion: Column, clipped: Column, complete: Column, intact: Column) -> Column:
    score = resolution - _lookup(suspicion, PENALTY) - F.when(clipped, CLIPPING_PENALTY).otherwise(0.0) + complete * METADATA_BONUS
    return F.when(intact, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(0.0)


def preference(intact: Column, suspicion: Column, score: Column, lossless: Column, clipped: Column, complete: Column) -> list[Column]:
    """Order of preference, best first; the caller adds the id."""
    return [intact.desc(), _lookup(suspicion, RANK).asc(), score.desc(), lossless.desc(), clipped.asc(), complete.desc()]


# Labels and display ------------------------------------------------------------------------


def lossless_label(lossless: Column) -> Column:
    return F.when(lossless, "LOSSLESS").otherwise("LOSSY")


def clipping_label(clipped: Column) -> Column:
    return F.when(clipped.isNull(), "UNKNOWN").when(clipped, "CLIPPED").otherwise("CLEAN")


def integrity_label(intact: Column) -> Column:
    return F.when(intact, "OK").otherwise("FAILED")


def show_number(value: Column, digits: int = 2) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def show_bytes(size: Column) -> Column:
    """With the largest unit that leaves 1 or more."""
    kilo = size.cast("double")
    out = F.format_string("%d B", size.cast("long"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(kilo >= 1024**i, F.format_string(f"%.1f {unit}", kilo / 1024**i)).otherwise(out)
    return F.when(size.isNull(), "-").otherwise(out)


def show_duration(ms: Column) -> Column:
    """Minutes and seconds."""
    seconds = F.round(ms / 1000).cast("long")
    return F.when(ms.isNull(), "-").otherwise(F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60))


#: How a difference is put into words; the first that tells two records apart counts.
REASONS = ("intact file", "less suspicion of a lossy source", "higher quality score", "lossless at an equal score", "no clipping", "more complete tags", "higher historical value")
TIED, ALONE = "tied in every respect, the first stays", "the only file of its group"


def choose(candidates: Column) -> Column:
    """struct(file_id, reasons): the best of an array, and why each later record lost or won against the best before it.

    Candidates are structs of file_id, intact, suspicion, score, lossless, clipped,
    complete and historical, in order of id. The first difference in that order
    decides; the historical value only where both have one.
    """
    rank = lambda c: _lookup(c["suspicion"], RANK).cast("double")
    yes = lambda x: x.cast("int").cast("double")

    def merits(c: Column) -> list[Column]:
        return [yes(c["intact"]), -rank(c), c["score"].cast("double"), yes(c["lossless"]), -yes(c["clipped"]), c["complete"].cast("double"), c["historical"].cast("double")]

    def step(state: Column, c: Column) -> Column:
        wins, reason = F.lit(False), F.lit(TIED)
        for a, b, name in reversed(list(zip(merits(state["best"]), merits(c), REASONS, strict=True))):
            differs = F.coalesce(a != b, F.lit(False))
            wins, reason = F.when(differs, b > a).otherwise(wins), F.when(differs, F.lit(name)).otherwise(reason)
        return F.struct(F.when(wins, c).otherwise(state["best"]).alias("best"), F.concat(state["reasons"], F.array(reason)).alias("reasons"))

    start = F.struct(F.get(candidates, 0).alias("best"), F.array().cast("array<string>").alias("reasons"))
    done = F.aggregate(F.slice(candidates, F.lit(2), F.greatest(F.size(candidates) - 1, F.lit(0))), start, step, lambda s: F.struct(s["best"]["file_id"].alias("file_id"), F.when(F.size(s["reasons"]) > 0, s["reasons"]).otherwise(F.array(F.lit(ALONE))).alias("reasons")))
    return F.when(F.size(candidates) > 0, done)
