"""Identity of a record from its tags and the name of its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text

SOURCES = ("TAG", "FILENAME", "UNKNOWN")


def public_id(prefix: str, *key: Column) -> Column:
    """The same id for the same key, so that a repeated task gives the same rows."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(prefix), *key), 256), 1, 32))


def _prefer(tag: Column, name: Column) -> tuple[Column, Column]:
    tag, name = text.valid(tag), text.valid(name)
    return F.coalesce(tag, name), F.when(tag.isNotNull(), "TAG").when(name.isNotNull(), "FILENAME").otherwise("UNKNOWN")


def resolved(files: DataFrame) -> DataFrame:
    """``files`` (relative_path, artist_raw, title_raw, ..) with resolved values, their sources, and featured names.

    Each of title, version and edition comes from the tag's title if that gives
    it, else from the file's name; the artist from its tag, else from the name.
    Featured names are taken out of artist and title and numbered in one row,
    those of the artist first.
    """
    name = F.element_at(F.split("relative_path", "/"), -1)
    parsed = files.withColumns({"_name": text.parse_filename(name), "_tag": text.title_annotations(text.valid(F.col("title_raw")))})
    picks = {f: _prefer(F.col("_tag")[f], F.col("_name")[f]) for f in ("title", "version", "edition")}
    picks["artist"] = _prefer(F.col("artist_raw"), F.col("_name")["artist"])
    out = parsed.withColumns({f"resolved_{f}": v for f, (v, _) in picks.items()} | {f"{f}_source": s for f, (_, s) in picks.items()})
    out = out.withColumns({"_a": text.split_featured(F.col("resolved_artist")), "_t": text.split_featured(F.col("resolved_title"))})
    entries = lambda side, source: F.transform(F.coalesce(F.col(side)["featured"], F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(source).alias("source")))
    numbered = F.transform(F.concat(entries("_a", "ARTIST"), entries("_t", "TITLE")), lambda x, i: F.struct(i.alias("position"), x["name"].alias("name"), x["source"].alias("source")))
    heads = {"resolved_artist": F.col("_a")["primary"], "resolved_title": F.col("_t")["primary"], "featured": numbered}
    return out.withColumns(heads).drop("_name", "_tag", "_a", "_t")


def featured_rows(files: DataFrame, key: str) -> DataFrame:
    """key, position, name, normalized_name, source of ``featured``."""
    return files.select(key, F.inline("featured")).withColumn("normalized_name", text.normalize_identity(F.col("name")))
