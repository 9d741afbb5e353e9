"""Queries for resolution, scans as one call, detection and consolidation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import analysis, commands, ingest, resolve
from kindred.plans.catalogue import MEMBERS_SQL, SNAPSHOT_SQL, members, query, snapshots, table

# Resolution, from part -------------------------------------------------------------------


@query("metadata_resolve", """
WITH r AS (SELECT p_partkey AS k, p_brand, p_name, p_type, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' feat. ' || p_type || ' & ' || p_brand ELSE '  ' END AS artist_tag,
  CASE WHEN p_partkey % 4 = 0 THEN p_name || ' (' || p_type || ' Dub) [Reissue]' WHEN p_partkey % 4 = 1 THEN p_name || ' ft. ' || p_type END AS title_tag, p_partkey % 5 < 3 AS named FROM part)
SELECT k AS file_id, CASE WHEN k % 3 = 0 OR named THEN p_brand END AS artist, CASE WHEN k % 3 = 0 THEN 'TAG' WHEN named THEN 'FILENAME' ELSE 'UNKNOWN' END AS artist_source,
  CASE WHEN k % 4 < 2 OR named THEN p_name END AS title, CASE WHEN k % 4 < 2 THEN 'TAG' WHEN named THEN 'FILENAME' ELSE 'UNKNOWN' END AS title_source,
  CASE WHEN k % 4 = 0 THEN p_type || ' Dub' WHEN named THEN p_type || ' Remix' END AS version, CASE WHEN k % 4 = 0 THEN 'TAG' WHEN named THEN 'FILENAME' ELSE 'UNKNOWN' END AS version_source,
  CASE WHEN k % 4 = 0 THEN 'Reissue' END AS edition, CASE WHEN k % 4 = 0 THEN 'TAG' ELSE 'UNKNOWN' END AS edition_source,
  concat_ws('|', CASE WHEN k % 3 = 0 THEN '0 ARTIST ' || p_type || '|1 ARTIST ' || p_brand END, CASE WHEN k % 4 = 1 THEN CASE WHEN k % 3 = 0 THEN '2' ELSE '0' END || ' TITLE ' || p_type END) AS featured FROM r""")
def metadata_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.when(key % 5 < 3, F.concat("p_brand", F.lit(" - "), "p_name", F.lit(" ("), "p_type", F.lit(" Remix).flac"))).otherwise(F.concat("p_name", F.lit(".wav")))
    artist = F.when(key % 3 == 0, F.concat("p_brand", F.lit(" feat. "), "p_type", F.lit(" & "), "p_brand")).otherwise("  ")
    title = F.when(key % 4 == 0, F.concat("p_name", F.lit(" ("), "p_type", F.lit(" Dub) [Reissue]"))).when(key % 4 == 1, F.concat("p_name", F.lit(" ft. "), "p_type"))
    r = resolve.resolved(table(spark, sf_dir, "part").select(key.alias("file_id"), F.concat(F.lit("a/b/"), name).alias("relative_path"), artist.alias("artist_raw"), title.alias("title_raw")))
    featured = F.array_join(F.transform("featured", lambda x: F.concat_ws(" ", x["position"].cast("string"), x["source"], x["name"])), "|")
    return r.select("file_id", *(c for f in ("artist", "title", "version", "edition") for c in (F.col(f"resolved_{f}").alias(f), f"{f}_source")), featured.alias("featured"))


# A scan, from orders -----------------------------------------------------------------------

SCAN_SQL = SNAPSHOT_SQL + """, z AS (SELECT relative_path, change, CAST(substr(relative_path, 3) AS BIGINT) % 17 = 0 AND change IN ('NEW', 'CHANGED') AS failed FROM d) """


def _scan(spark: SparkSession, sf_dir: str) -> ingest.Scan:
    """The snapshots of ``orders`` as known and found files; every 17th cannot be read."""
    old, found = snapshots(spark, sf_dir)
    text, number = F.lit("old").cast("string"), F.lit(0).cast("long")
    known = old.withColumns({"file_id": resolve.public_id("fil", F.col("relative_path")), "is_present": F.lit(True), "first_seen_at": F.lit(1), "last_seen_at": F.lit(1)})
    known = known.withColumns({c: number if c in ingest.TYPES else text for c in ingest.METADATA} | {f"resolved_{f}": text for f in ingest.IDENTITY} | {f"{f}_source": F.lit("TAG") for f in ingest.IDENTITY} | {a: F.lit("CURRENT") for a in ingest.ANALYSES})
    known = known.withColumn("featured", F.array().cast(ingest.FEATURED))
    track = resolve.public_id("trk", F.col("relative_path"))
    links = known.select("file_id", track.alias("track_id"), F.lit("PRIMARY").alias("relationship"), F.lit("AUTOMATIC").alias("decision_source"), F.lit(True).alias("is_active"))
    tracks = known.select(track.alias("track_id"), F.lit("ACTIVE").alias("status"), *(text.alias(f) for f in ingest.IDENTITY), F.lit(None).cast("string").alias("preferred_file_id"), F.lit(None).cast("string").alias("merged_into"), "featured")
    read = ingest.to_read(known, found)
    bad = F.substring("relative_path", 3, 20).cast("long") % 17 == 0
    values = {c: F.lit(1).cast("long") if c in ingest.TYPES else F.lit("new") for c in ingest.METADATA} | {"title_raw": F.concat(F.lit("Song "), "relative_path"), "artist_raw": F.lit("Someone")}
    metadata = read.select("relative_path", *(F.when(~bad, v).alias(c) for c, v in values.items()), F.when(bad, "unreadable").alias("error"))
    return ingest.apply(known, found, metadata, tracks, links, F.lit(2))


@query("scan_upsert", SCAN_SQL + """SELECT relative_path, change <> 'MISSING' AS is_present, CASE WHEN change = 'MISSING' THEN 1 ELSE 2 END AS last_seen_at, CASE change WHEN 'NEW' THEN 'PENDING' WHEN 'CHANGED' THEN 'STALE' ELSE 'CURRENT' END AS quality_status,
  CASE WHEN change IN ('UNCHANGED', 'MISSING') OR (failed AND change = 'CHANGED') THEN 'old' WHEN NOT failed THEN 'Song ' || relative_path END AS resolved_title FROM z""")
def scan_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).files.select("relative_path", "is_present", "last_seen_at", "quality_status", "resolved_title")


@query("scan_tracks", SCAN_SQL + """SELECT CASE change WHEN 'NEW' THEN 'PROVISIONAL' ELSE 'ACTIVE' END AS status, CASE WHEN change IN ('UNCHANGED', 'MISSING') OR (failed AND change = 'CHANGED') THEN 'old' WHEN NOT failed THEN 'Someone' END AS artist, count(*)::BIGINT AS n FROM z GROUP BY 1, 2""")
def scan_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scan(spark, sf_dir)
    owned = s.links.where("is_active").join(s.tracks, "track_id")
    return owned.groupBy("status", "artist").agg(F.count("*").alias("n"))


@query("scan_run", SCAN_SQL + """SELECT count(*) FILTER (WHERE change <> 'MISSING')::BIGINT AS files_seen, count(*) FILTER (WHERE change = 'NEW')::BIGINT AS files_new, count(*) FILTER (WHERE change = 'CHANGED')::BIGINT AS files_changed,
  count(*) FILTER (WHERE change = 'UNCHANGED')::BIGINT AS files_unchanged, count(*) FILTER (WHERE change = 'MISSING')::BIGINT AS files_missing, count(*) FILTER (WHERE failed)::BIGINT AS files_failed,
  CASE WHEN count(*) FILTER (WHERE failed) > 0 THEN 'SUCCESS_WITH_ERRORS' ELSE 'SUCCESS' END AS status,
  (SELECT string_agg(relative_path, ', ' ORDER BY relative_path) FROM (SELECT relative_path FROM z WHERE failed ORDER BY relative_path LIMIT 20)) || CASE WHEN count(*) FILTER (WHERE failed) > 20 THEN ', ...' ELSE '' END AS error_summary FROM z""")
def scan_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.counters(_scan(spark, sf_dir).changes)


# Groups, from documents ----------------------------------------------------------------------


@query("group_reuse", MEMBERS_SQL + ", s AS (SELECT group_id, string_agg(file_id::VARCHAR, ',' ORDER BY file_id) AS key FROM m GROUP BY group_id), k AS (SELECT 'known ' || group_id AS old, string_agg(file_id::VARCHAR, ',' ORDER BY file_id) AS key FROM m WHERE group_id % 2 = 0 OR file_id <> group_id GROUP BY group_id) SELECT group_id AS component, old FROM s LEFT JOIN k USING (key)")
def group_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known groups are those of even ids whole, and those of odd ids without a member."""
    found = members(spark, sf_dir).select("group_id", "file_id")
    known = found.where("group_id % 2 = 0 or file_id <> group_id").withColumn("group_id", F.concat(F.lit("known "), F.col("group_id").cast("string")))
    keys, old = analysis.set_key(found).withColumnRenamed("group_id", "component"), analysis.set_key(known).withColumnRenamed("group_id", "old")
    return keys.join(old, "key", "left").select("component", "old")


def _group_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, preferred files and evidence: pairs with the preferred file are exact if the sum of their ids is even, and unknown if it is divisible by 7."""
    m = members(spark, sf_dir).select("group_id", "file_id", "path")
    best = m.groupBy("group_id").agg(F.max("file_id").alias("preferred_file_id"))
    total = F.col("file_id") + F.col("preferred_file_id")
    pairs = m.join(best, "group_id").where(total % 7 != 0).where("file_id <> preferred_file_id")
    evidence = pairs.select("group_id", F.col("preferred_file_id").alias("left_file_id"), F.col("file_id").alias("right_file_id"), F.when(total % 2 == 0, "EXACT").otherwise("AUDIO_EQUIVALENT").alias("classification"))
    return m, best, evidence


RELATION = "CASE WHEN file_id = best THEN 'PRIMARY' WHEN (file_id + best) % 14 <> 0 AND (file_id + best) % 2 = 0 THEN 'EXACT_DUPLICATE' ELSE 'AUDIO_EQUIVALENT' END"


@query("file_relationship", MEMBERS_SQL + f", b AS (SELECT group_id, max(file_id) AS best FROM m GROUP BY group_id) SELECT group_id, file_id, best AS preferred_file_id, {RELATION} AS relationship FROM m JOIN b USING (group_id)")
def file_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, best, evidence = _group_tables(spark, sf_dir)
    return commands.relationships(m, best, evidence)


@query("consolidated_links", MEMBERS_SQL + f", b AS (SELECT group_id, max(file_id) AS best FROM m GROUP BY group_id), j AS (SELECT d.file_id, best FROM d LEFT JOIN m ON m.file_id = d.file_id LEFT JOIN b ON b.group_id = m.group_id) SELECT file_id, 'trk ' || coalesce(best, file_id) AS track_id, CASE WHEN best IS NULL THEN 'PRIMARY' ELSE {RELATION} END AS relationship, CASE WHEN best IS NULL OR best = file_id THEN 'SCAN' ELSE 'AUTOMATIC' END AS decision_source FROM j")
def consolidated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file with a track of its own until its group is folded."""
    return _consolidated(spark, sf_dir)[0].links.select("file_id", "track_id", "relationship", "decision_source")


@query("consolidation_events", MEMBERS_SQL + "SELECT 'TRACK_MERGE' AS event_type, (SELECT count(*) FROM m)::BIGINT - (SELECT count(DISTINCT group_id) FROM m)::BIGINT AS n UNION ALL SELECT 'TRACK_PREFERRED_FILE_AUTO_SET', (SELECT count(DISTINCT group_id) FROM m)::BIGINT")
def consolidation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consolidated(spark, sf_dir)[0].events.groupBy("event_type").agg(F.count("*").alias("n"))


def _consolidated(spark: SparkSession, sf_dir: str) -> tuple[commands.Change, int]:
    m, best, evidence = _group_tables(spark, sf_dir)
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("relative_path"))
    track = F.concat(F.lit("trk "), F.col("file_id").cast("string"))
    links = files.select("file_id", track.alias("track_id"), F.lit("PRIMARY").alias("relationship"), F.lit("SCAN").alias("decision_source"), F.lit(True).alias("is_active"))
    tracks = files.select(track.alias("track_id"), F.lit("PROVISIONAL").alias("status"), F.lit(None).cast("string").alias("preferred_file_id"), F.lit(None).cast("string").alias("merged_into"))
    return commands.consolidate(best, m.select("group_id", "file_id"), evidence, tracks, links, files)
