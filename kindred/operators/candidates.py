"""Candidate pairs of all tiers, and the best tier of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions import text
from kindred.operators import blocking

STRONG, CANDIDATE, WEAK = 3, 2, 1


def _names(pairs: DataFrame) -> DataFrame:
    return pairs.where("l_title <> r_title").select(F.least("l_title", "r_title").alias("a"), F.greatest("l_title", "r_title").alias("b"))


def _both_ways(names: DataFrame, *others: str) -> DataFrame:
    """title, other: each of two names with the other one."""
    ways = [F.struct(F.col(x).alias("title"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a"))]
    return names.select(F.explode(F.array(*ways)).alias("t"), *others).select("t.*", *others)


def _in_reach(records: DataFrame) -> DataFrame:
    """a, b, repeated: all different titles that an artist has in cells within reach."""
    left = blocking.cells(records, ["artist"], "tol").select("artist", "cell", "l_title").distinct()
    return _names(left.join(blocking.cells(records, ["artist"]).select("artist", "cell", "r_title").distinct(), ["artist", "cell"]))


def title_ratios(records: DataFrame) -> DataFrame:
    """a, b, ratio of the different titles that an artist has within a band.

    Records of one band in the same stretch as long as the band are in it for
    sure, so there titles meet once a stretch. Records meet only where a pair of
    titles in reach has no such stretch.
    """
    r = records.select("artist", "title", "duration_ms", "tol").where("artist <> '' and title <> ''").distinct()
    stretch = r.where("tol > 0").select("artist", "tol", F.floor(F.col("duration_ms") / F.col("tol")).alias("at"), "title").distinct()
    sure = _names(stretch.withColumnRenamed("title", "l_title").join(stretch.withColumnRenamed("title", "r_title"), ["artist", "tol", "at"]).where("l_title < r_title")).distinct()
    left = r.join(_both_ways(_in_reach(r).distinct().join(sure, ["a", "b"], "left_anti")), "title")
    left = left.select("artist", F.col("other").alias("title"), "duration_ms", "tol", F.col("title").alias("own"))
    met = blocking.reached(left, r, ["artist", "title"]).select(F.col("l_own").alias("l_title"), F.col("title").alias("r_title"))
    return _rated(sure.unionByName(_names(met)))


def _rated(names: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The distinct a, b of ``names`` with their ratio, if it reaches the threshold; those too different in length are left out before."""
    a, b = F.col("a"), F.col("b")
    return names.where(text.highest_ratio(a, b) >= threshold).distinct().withColumn("ratio", text.indel_ratio(a, b)).where(F.col("ratio") >= threshold)


def _of_an_artist(records: DataFrame) -> DataFrame:
    """a, b, repeated: all different titles that an artist has, whatever their durations."""
    titles = records.where("artist <> ''").select("artist", "title").distinct()
    return _names(titles.withColumnRenamed("title", "l_title").join(titles.withColumnRenamed("title", "r_title"), "artist").where("l_title < r_title"))


def _squares(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)).alias("n"))


def _alike(records: DataFrame, threshold: float) -> DataFrame:
    """title, other, ratio: all titles that are alike and that an artist has in cells within reach, each two rated once.

    Where artists have the same titles in many cells, their titles meet once an
    artist instead, which finds these and perhaps more.
    """
    r = records.where("title <> ''")
    in_cells = blocking.cells(r, ["artist"]).select("artist", "cell", "r_title").distinct()
    of_artists, of_cells = (x.n for x in _squares(in_cells.select("artist", "r_title").distinct(), "artist").unionAll(_squares(in_cells, "artist", "cell")).collect())
    return _both_ways(_rated(_of_an_artist(r) if of_artists <= of_cells else _in_reach(r), threshold), "ratio")


def candidate_pairs(records: DataFrame, threshold: float = 85.0, sides: tuple[str, ...] = ()) -> DataFrame:
    """Same artist, different titles that are alike. Titles are rated first, so only records of such titles meet."""
    more = [c for c in sides if c != "duration_ms"]
    r = records.select("file_id", "artist", "title", "duration_ms", "tol", *more)
    left = r.join(_alike(r, threshold), "title").select("file_id", "artist", F.col("other").alias("title"), "duration_ms", "tol", "ratio", *more)
    pairs = blocking.reached(left, r, ["artist", "title"]).where(blocking.once())
    return blocking.ids(pairs, "l_ratio", sides=sides).withColumnRenamed("l_ratio", "ratio")


def _tiers(records: DataFrame) -> DataFrame:
    tiers = [(blocking.strong_pairs(records), STRONG), (candidate_pairs(records).drop("ratio"), CANDIDATE), (blocking.weak_pairs(records), WEAK)]
    out = None
    for pairs, rank in tiers:
        part = pairs.withColumn("tier", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    return out


def best_tier(records: DataFrame) -> DataFrame:
    """left_id, right_id and the highest tier that has the pair; dealt out by left_id."""
    return _tiers(records).repartition("left_id").groupBy("left_id", "right_id").agg(F.max("tier").alias("tier"))


def repeated_ids(records: DataFrame) -> bool:
    return not records.groupBy("file_id").count().where("count > 1").isEmpty()


def compared(records: DataFrame, sides: tuple[str, ...] = ()) -> DataFrame:
    """left_id, right_id, tier, artist_similarity, title_similarity, and l_ and r_ columns of ``sides``. No id may be repeated.

    Then a pair is in one tier only: strong and candidate pairs have one artist
    and differ in whether their titles do, weak pairs lack an artist. The tier
    tells both similarities, so nothing is gathered by pair and no name is rated again.
    """
    one, same = F.lit(1.0), F.coalesce("l_artist", F.lit("")) == F.coalesce("r_artist", F.lit(""))
    strong = blocking.strong_pairs(records, sides).withColumns({"tier": F.lit(STRONG), "artist_similarity": one, "title_similarity": one})
    like = candidate_pairs(records, sides=sides).withColumns({"tier": F.lit(CANDIDATE), "artist_similarity": one, "title_similarity": F.col("ratio") / 100}).drop("ratio")
    weak = blocking.weak_pairs(records, ("artist", *sides)).withColumns({"tier": F.lit(WEAK), "artist_similarity": F.when(same, one).otherwise(0.0), "title_similarity": one})
    return strong.unionByName(like).unionByName(weak.drop("l_artist", "r_artist"))


def linking_pairs(records: DataFrame, threshold: float = 85.0) -> DataFrame:
    """left_id, right_id: pairs of any tier that connect all that all pairs connect; some come twice.

    Records with one artist, title, duration and band are in pairs with one
    another and with the same others. So the first of them meets the others of
    its kind, and stands for them in the links with records of other kinds: a
    few a record, as an artist's records of one title, or of two that are alike,
    are in pairs with all in their band.
    """
    kind = ["artist", "title", "duration_ms", "tol", "wtol"]
    usable = records.select("file_id", *kind).where("title <> '' and duration_ms is not null and tol >= 0 and wtol >= 0")
    first = usable.groupBy(*kind).agg(F.min("file_id").alias("file_id"))
    same = usable.withColumn("first", F.min("file_id").over(Window.partitionBy(*kind))).where("first < file_id")
    named = first.where("artist <> ''")
    pair = [F.least("title", "other").alias("a"), F.greatest("title", "other").alias("b")]
    alike = named.join(_alike(usable, threshold), "title").select("file_id", "artist", *pair, "duration_ms", "tol")
    links = blocking.strong_links(first).unionByName(blocking.weak_links(first)).unionByName(blocking.covering(alike, ["artist", "a", "b"]))
    return links.unionByName(same.select(F.col("first").alias("left_id"), F.col("file_id").alias("right_id")))
