"""Candidate pairs by blocking keys and a duration band; always an equi-join, never all pairs.

Durations are cut into cells. A record meets the cells that its own band reaches,
so a key of very many records is spread over many join keys, and bands of any
width are complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of a cell of durations, in milliseconds.
CELL = 5000


def with_tolerance(records: DataFrame, short: int = 2000, medium: int = 3000, long: int = 5000) -> DataFrame:
    """Adds tol and wtol: the widest duration difference, and that of the weak tier."""
    d = F.col("duration_ms")
    out = records.withColumn("tol", F.when(d <= 300_000, short).when(d <= 600_000, medium).otherwise(long).cast("long"))
    return out.withColumn("wtol", F.greatest(F.lit(1000).cast("long"), F.floor(F.col("tol") / 2)))


def cells(records: DataFrame, keys: list[str], tol: str | None = None) -> DataFrame:
    """``keys`` and the cell of each record's duration, or all cells within its ``tol``; the other columns begin with r_, or l_."""
    d, side = F.col("duration_ms"), "l_" if tol else "r_"
    usable = records
    for k in keys:
        usable = usable.where(F.coalesce(F.col(k), F.lit("")) != "")
    others = [F.col(c).alias(side + c) for c in records.columns if c not in keys]
    if not tol:
        return usable.select(*keys, F.floor(d / CELL).alias("cell"), *others)
    usable = usable.where(d.isNotNull() & (F.col(tol) >= 0))
    return usable.select(*keys, F.explode(F.sequence(F.floor((d - F.col(tol)) / CELL), F.floor((d + F.col(tol)) / CELL))).alias("cell"), *others)


def reached(left: DataFrame, right: DataFrame, keys: list[str], tol: str = "tol") -> DataFrame:
    """Each row of ``left`` with the rows of ``right`` of the same keys whose duration is within its own ``tol``."""
    delta = F.abs(F.col("l_duration_ms") - F.col("r_duration_ms"))
    return cells(left, keys, tol).join(cells(right, keys), [*keys, "cell"]).where(delta <= F.col(f"l_{tol}"))


def once(column: str = "file_id") -> Column:
    """Of the two ways to find a pair, the one from the record of the wider band; of equal bands, from the lesser ``column``."""
    l, r = F.col("l_tol"), F.col("r_tol")
    return (F.col(f"l_{column}") != F.col(f"r_{column}")) & ((l > r) | ((l == r) & (F.col(f"l_{column}") < F.col(f"r_{column}"))))


def ids(pairs: DataFrame, *others: str, sides: tuple[str, ...] = ()) -> DataFrame:
    """left_id, right_id (the greater), ``others``, and l_ and r_ columns of ``sides``: those of left_id and of right_id."""
    first = F.col("l_file_id") < F.col("r_file_id")
    both = [F.when(first, F.col(x + c)).otherwise(F.col(y + c)).alias(x + c) for c in sides for x, y in (("l_", "r_"), ("r_", "l_"))]
    return pairs.select(F.least("l_file_id", "r_file_id").alias("left_id"), F.greatest("l_file_id", "r_file_id").alias("right_id"), *others, *both)


def _with(columns: list[str], sides: tuple[str, ...]) -> list[str]:
    return columns + [c for c in sides if c not in columns]


def strong_pairs(records: DataFrame, sides: tuple[str, ...] = ()) -> DataFrame:
    """Same artist and title; a pair counts if it is in the band of either record."""
    r = records.select(*_with(["file_id", "artist", "title", "duration_ms", "tol"], sides))
    return ids(reached(r, r, ["artist", "title"]).where(once()), sides=sides)


def weak_pairs(records: DataFrame, sides: tuple[str, ...] = ()) -> DataFrame:
    """Same title and a missing artist on a side that allows it; the bands are those of the source."""
    r = records.select(*_with(["file_id", "artist", "title", "duration_ms", "wtol"], sides))
    open_ = F.coalesce(F.col("artist"), F.lit("")) == ""
    meet = reached(r.where(open_), r, ["title"], "wtol").unionByName(reached(r.where(~open_), r.where(F.col("artist").isNull()), ["title"], "wtol"))
    back = (F.coalesce(F.col("r_artist"), F.lit("")) == "") | F.col("l_artist").isNull()
    back = back & (F.abs(F.col("l_duration_ms") - F.col("r_duration_ms")) <= F.col("r_wtol"))
    return ids(meet.where((F.col("l_file_id") < F.col("r_file_id")) | ((F.col("l_file_id") > F.col("r_file_id")) & ~back)), sides=sides)


# Links: few pairs that connect all that the pairs of a tier connect ----------------------------


def _ways(keys: list[str]) -> list[tuple[Column, Window]]:
    """Durations and the order by them, upwards and downwards."""
    d, w = F.col("duration_ms"), Window.partitionBy(*keys)
    return [(d, w.orderBy(d, "file_id")), (-d, w.orderBy(d.desc(), F.col("file_id").desc()))]


def _linked(rows: DataFrame, other: str) -> DataFrame:
    return rows.where(F.col("file_id") != F.col(other)).select(F.least("file_id", other).alias("left_id"), F.greatest("file_id", other).alias("right_id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def covering(records: DataFrame, keys: list[str], tol: str = "tol", covers: Column | None = None) -> DataFrame:
    """Each record with the one before it, and the one after it, whose band reaches furthest, if it reaches the record.

    ``covers`` are the records that pair with all others of their keys within
    their own band. What lies between such a record and one it reaches is in its
    band too, so two that reach the same record are connected already.
    """
    out = []
    for at, w in _ways(keys):
        reach = F.struct((at + F.col(tol)).alias("reach"), F.col("file_id").alias("by"))
        best = F.max(reach if covers is None else F.when(covers, reach)).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out.append(_linked(records.withColumn("best", best).where(F.col("best.reach") >= at).withColumn("by", F.col("best.by")), "by"))
    return _union(out)


def strong_links(records: DataFrame) -> DataFrame:
    return covering(records.where("artist <> '' and title <> ''"), ["artist", "title"])


def weak_links(records: DataFrame) -> DataFrame:
    """Records without an artist pair with all in their band; those with one only with null artists in theirs.

    So of the latter each meets the next null artist on both sides, and each
    null artist the one that reaches furthest of those that reach over the null
    artist before it.
    """
    r = records.where("title <> ''")
    named = F.coalesce(F.col("artist"), F.lit("")) != ""
    out = [covering(r, ["title"], "wtol", ~named)]
    for at, w in _ways(["title"]):
        reach = F.when(named, F.struct((at + F.col("wtol")).alias("reach"), F.col("file_id").alias("by")))
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        near = F.last(F.when(F.col("artist").isNull(), F.struct(at.alias("at"), F.col("file_id").alias("by"))), ignorenulls=True).over(before)
        seen = r.withColumns({"near": near, "best": F.max(reach).over(before)})
        out.append(_linked(seen.where(named & (at - F.col("near.at") <= F.col("wtol"))).withColumn("by", F.col("near.by")), "by"))
        over = seen.where("artist is null").withColumn("best", F.lag("best").over(w))
        out.append(_linked(over.where(F.col("best.reach") >= at).withColumn("by", F.col("best.by")), "by"))
    return _union(out)
