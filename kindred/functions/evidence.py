"""Evidence of a pair of records, and its class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Versions that never match a record without a version.
STANDALONE_VERSIONS = ("live", "instrumental", "bootleg")
CLASSES = ("EXACT", "AUDIO_EQUIVALENT", "PROBABLE", "DIFFERENT", "CONFLICT")


def version_compatibility(left: Column, right: Column) -> Column:
    a, b = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    one = F.when(a == "", b).when(b == "", a)
    return F.when(a == b, "COMPATIBLE").when(one.isNull() | one.isin(*STANDALONE_VERSIONS), "INCOMPATIBLE").otherwise("COMPATIBLE_WEAK")


def edition_compatibility(left: Column, right: Column) -> Column:
    return F.when(F.coalesce(left, F.lit("")) == F.coalesce(right, F.lit("")), "COMPATIBLE").otherwise("COMPATIBLE_WEAK")


def composite_similarity(artist: Column, title: Column, featured: Column) -> Column:
    """Weights 0.5, 0.4 and, where featured names are known, 0.1."""
    two = F.lit(0.5) * artist + F.lit(0.4) * title
    return F.when(featured.isNull(), two / F.lit(0.9)).otherwise(two + F.lit(0.1) * featured)


def classify(same_bytes: Column, version: Column, sound: Column, auto: float = 0.985, review: float = 0.93) -> Column:
    """struct(classification, confidence); an unknown sound similarity counts as 0."""
    s = F.coalesce(sound, F.lit(0.0))
    clash = version == "INCOMPATIBLE"
    name = F.when(same_bytes, "EXACT").when(clash & (s >= review), "CONFLICT").when(~clash & (s >= auto), "AUDIO_EQUIVALENT").when(s >= review, "PROBABLE").otherwise("DIFFERENT")
    return F.struct(name.alias("classification"), F.when(name == "EXACT", 1.0).when(name == "DIFFERENT", F.lit(1.0) - s).otherwise(s).alias("confidence"))
