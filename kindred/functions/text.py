"""Text of names: normal form, parts of file names, annotations, featured names and similarity.

Patterns are Unicode-aware. Everything is a built-in expression but the normal
form of text outside ASCII, which needs NFKC and case folding.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values ---------------------------------------------------------------------------
DASHES = "‐‑‒–—―−"
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟″"
VERSION_WORDS = ("remix", "mix", "edit", "rework", "bootleg", "mashup", "vip", "dub", "instrumental", "live")
EDITION_WORDS = ("remaster(?:ed)?", "anniversary edition", "deluxe edition", "reissue")
# ----------------------------------------------------------------------------------------

_TABLE = {**dict.fromkeys(map(ord, DASHES), "-"), **dict.fromkeys(map(ord, SINGLE_QUOTES), "'"), **dict.fromkeys(map(ord, DOUBLE_QUOTES + '"'), None)}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _normal_unicode(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        return None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).translate(_TABLE).casefold()).strip()

    return s.map(one, na_action="ignore")


def normalize_identity(c: Column) -> Column:
    """Case-folded, with plain dashes and quotes and single spaces. Only text outside ASCII goes to Python."""
    ascii_ = c.rlike(r"^[\x00-\x7F]*$")
    plain = F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit('"'), F.lit(""))), r"[\s\x1C-\x1F]+", " "))
    return F.when(ascii_, plain).otherwise(_normal_unicode(F.when(~ascii_, c)))


def valid(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _without_first(s: Column, part: Column) -> Column:
    at = F.instr(s, part)
    return F.when(part.isNull() | (at == 0), s).otherwise(F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + F.length(part), F.length(s))))


def title_annotations(title: Column) -> Column:
    """struct(title, version, edition): the first bracketed group ending in a word of each kind is taken out."""
    groups = F.regexp_extract_all(title, F.lit(r"[(\[][^()\[\]]+[)\]]"), F.lit(0))

    def first(words: tuple[str, ...]) -> Column:
        return F.get(F.filter(groups, lambda g: g.rlike(r"(?iU)\b(?:" + "|".join(words) + r")\s*.$")), 0)

    edition, version = first(EDITION_WORDS), first(VERSION_WORDS)
    inner = lambda g: strip(F.substring(g, F.lit(2), F.length(g) - 2))
    rest = _without_first(_without_first(title, edition), version)
    return F.struct(strip(F.regexp_replace(rest, r"(?U)\s+", " ")).alias("title"), inner(version).alias("version"), inner(edition).alias("edition"))


def parse_filename(name: Column) -> Column:
    """struct(artist, title, version, edition) of ``artist - title.suffix``; all null unless there are just two parts."""
    stem = F.translate(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""), DASHES, "-" * len(DASHES))
    parts = F.split(F.regexp_replace(strip(stem), r"(?U)^\d{1,3}\s*[-.]\s*", ""), r"(?U)\s+-\s+", -1)
    artist, rest = strip(F.get(parts, 0)), strip(F.get(parts, 1))
    good = (F.size(parts) == 2) & (artist != "") & (rest != "")
    t = title_annotations(F.when(good, rest))
    return F.struct(F.when(good, artist).alias("artist"), t["title"].alias("title"), t["version"].alias("version"), t["edition"].alias("edition"))


def split_featured(artist: Column) -> Column:
    """struct(primary, featured): the names behind the first mark of featured artists."""
    mark = r"(?iU)\bfeaturing\b|\b(?:feat|ft)\.?(?!\w)"
    found = F.regexp_substr(artist, F.lit(mark))
    at = F.regexp_instr(artist, F.lit(mark))
    head = strip(F.regexp_replace(strip(F.substring(artist, F.lit(1), at - 1)), r"[(\[]+$", ""))
    tail = strip(F.regexp_replace(strip(F.substring(artist, at + F.length(found), F.length(artist))), "^[:-]", ""))
    tail = strip(F.regexp_replace(tail, r"[)\]]+$", ""))
    names = F.filter(F.transform(F.split(tail, r"(?iU)\s*(?:,|&|\band\b)\s*"), strip), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.struct(F.when(found.isNull(), strip(artist)).otherwise(head).alias("primary"), F.when(found.isNull(), none).otherwise(names).alias("featured"))


#: Places of the shorter text that fit in the bits of a long, with room for a carry.
WORD_BITS = 62


@F.pandas_udf(T.LongType())
def _long_common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        at: dict[str, int] = {}
        for i, ch in enumerate(x):
            at[ch] = at.get(ch, 0) | 1 << i
        full = free = (1 << len(x)) - 1
        for ch in y:
            hit = free & at.get(ch, 0)
            free = (free + hit | free - hit) & full
        return len(x) - free.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, with a bit for each place of the shorter text.

    A bit is cleared where a subsequence grows, for all places of the shorter text
    at once, so the work is one step a character of the longer one. Only pairs
    whose shorter text is longer than a word has bits go to Python, where integers
    have any length.
    """

    def bits(short: Column, other: Column) -> Column:
        chars = F.split(short, "")
        bit = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.call_function("shiftleft", F.lit(1).cast("long"), i).alias("bit")))
        none = F.lit(0).cast("long")
        masks = F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("c"), F.aggregate(bit, none, lambda s, x: s + F.when(x.c == c, x.bit).otherwise(none)).alias("bits")))
        full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(short)) - 1

        def of(m: Column) -> Column:
            def step(free: Column, ch: Column) -> Column:
                hit = F.coalesce(F.element_at(m.at, ch), none).bitwiseAND(free)
                return F.get(F.transform(F.array(hit), lambda h: (free + h).bitwiseOR(free - h).bitwiseAND(m.full)), 0)

            return F.length(short) - F.bit_count(F.aggregate(F.split(other, ""), m.full, step))

        return F.get(F.transform(F.array(F.struct(F.map_from_entries(masks).alias("at"), full.alias("full"))), of), 0)

    short, other = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    fits = F.length(short) <= WORD_BITS
    beyond = _long_common_subsequence(F.when(~fits, short), F.when(~fits, other))
    return F.when(F.length(short) == 0, 0).when(fits, bits(short, other)).otherwise(beyond.cast("int"))


def indel_ratio(a: Column, b: Column) -> Column:
    """0 to 100: twice the common subsequence over both lengths."""
    return F.when(a == b, 100.0).otherwise(F.lit(200.0) * common_subsequence(a, b) / (F.length(a) + F.length(b)))


def highest_ratio(a: Column, b: Column) -> Column:
    """A bound of ``indel_ratio`` by the lengths alone."""
    return F.lit(200.0) * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def similarity(a: Column, b: Column) -> Column:
    """0 to 1; null counts as empty, two empty values are the same."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(indel_ratio(a, b) / 100)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of names; null where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
