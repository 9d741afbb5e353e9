"""Queries for exports, statistics, review, decisions, replay and tool output, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import decisions, replay, reports
from kindred.plans.catalogue import MEMBERS_SQL, members, query, table
from kindred.sources import adapters

# Catalogue and statistics, from part, lineitem and orders --------------------------------


@query("catalog_export", """
WITH f AS (SELECT p_partkey AS file_id, p_name, p_brand, p_type, p_partkey % 13 <> 0 AS linked FROM part),
q AS (SELECT l_partkey AS file_id, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity::BIGINT) AS quality_score FROM lineitem GROUP BY l_partkey)
SELECT f.file_id, 'f/' || f.file_id AS relative_path, CASE WHEN linked THEN f.file_id END AS track_id, CASE WHEN linked THEN 'ACTIVE' END AS track_status,
  CASE WHEN linked THEN lower(p_brand) ELSE p_brand END AS artist, CASE WHEN linked THEN lower(p_name) ELSE p_name END AS title, CASE WHEN linked THEN p_type END AS version,
  CASE WHEN linked THEN p_brand || ', ' || p_type ELSE '' END AS featured_artists, quality_score FROM f LEFT JOIN q USING (file_id)""")
def catalog_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    files = p.select(key.alias("file_id"), F.concat(F.lit("f/"), key.cast("string")).alias("relative_path"), F.col("p_brand").alias("artist_raw"), F.col("p_name").alias("title_raw"))
    links = p.select(key.alias("file_id"), key.alias("track_id"), (key % 13 != 0).alias("is_active"))
    identity = p.select(key.alias("track_id"), F.lit("ACTIVE").alias("track_status"), F.lower("p_brand").alias("artist"), F.lower("p_name").alias("title"), F.col("p_type").alias("version"))
    featured = p.select(key.alias("track_id"), F.explode(F.array(F.struct(F.lit(2).alias("position"), F.col("p_type").alias("name")), F.struct(F.lit(1).alias("position"), F.col("p_brand").alias("name")))).alias("f")).select("track_id", "f.*")
    quality = table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("long")).alias("id"), F.col("l_partkey").alias("file_id"), F.col("l_quantity").alias("quality_score"))
    return reports.catalog_rows(files, links, identity, featured, quality)


STATUS = "CASE p_partkey % 5 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'MERGED' ELSE 'PROVISIONAL' END"


def _zero_filled(category: str, values: tuple[str, ...], source: str) -> str:
    return f"SELECT '{category}' AS category, lower(v) AS metric, count(s)::VARCHAR AS value FROM (SELECT unnest({list(values)}) AS v) LEFT JOIN ({source}) ON s = v GROUP BY v"


@query("stats_long", f"""
SELECT 'files' AS category, m AS metric, n::VARCHAR AS value FROM (SELECT unnest(['total', 'present', 'missing']) AS m, unnest([count(*), count(*) FILTER (WHERE p_partkey % 13 <> 0), count(*) FILTER (WHERE p_partkey % 13 = 0)]) AS n FROM part)
UNION ALL {_zero_filled("tracks", reports.TRACK_STATUSES, f"SELECT {STATUS} AS s FROM part")}
UNION ALL {_zero_filled("duplicate_groups", reports.GROUP_STATUSES, "SELECT CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'REVIEW_REQUIRED' ELSE 'REJECTED' END AS s FROM orders")}
UNION ALL SELECT 'scans', m, n FROM (SELECT unnest(['runs_total', 'failed_files_total', 'latest_scan_public_id', 'latest_scan_status']) AS m,
  unnest([count(*)::VARCHAR, sum(user_id % 4)::BIGINT::VARCHAR, 'scan_' || arg_max(event_id, (ts, event_id)), arg_max(event_type, (ts, event_id))]) AS n FROM events)""")
def stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    tracks = p.select(F.when(key % 5 == 0, "ACTIVE").when(key % 5 == 1, "MERGED").otherwise("PROVISIONAL").alias("status"))
    groups = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "CONFIRMED").when(F.col("o_orderstatus") == "O", "REVIEW_REQUIRED").otherwise("REJECTED").alias("status"))
    scans = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("scan_"), F.col("event_id").cast("string")).alias("public_id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"), (F.col("user_id") % 4).alias("files_failed"))
    out = reports.file_stats(p.select((key % 13 != 0).alias("is_present")))
    for part in (reports.counts_by(tracks, "tracks", "status", reports.TRACK_STATUSES), reports.counts_by(groups, "duplicate_groups", "status", reports.GROUP_STATUSES), reports.scan_stats(scans)):
        out = out.unionByName(part)
    return out


# Review of groups, from documents of equal text ---------------------------------------------

GROUPS_SQL = MEMBERS_SQL + """, gs AS (SELECT group_id, count(*)::BIGINT AS file_count, min(path) AS sort_path, CASE WHEN group_id % 3 = 0 THEN 'AUTO_CONFIRMED' ELSE 'REVIEW_REQUIRED' END AS status,
  CASE WHEN group_id % 7 <> 0 THEN (group_id % 8) / 8.0::DOUBLE END AS confidence, list(DISTINCT split_part(path, '/', 1)) AS formats, CASE WHEN group_id % 5 = 0 THEN 'DEFER' END AS decision FROM m GROUP BY group_id) """


def open_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = members(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("file_count"), F.min("path").alias("sort_path"), F.collect_set(F.split_part("path", F.lit("/"), F.lit(1))).alias("formats"))
    i = F.col("group_id")
    return g.withColumns({"status": F.when(i % 3 == 0, "AUTO_CONFIRMED").otherwise("REVIEW_REQUIRED"), "confidence": F.when(i % 7 != 0, i % 8 / F.lit(8.0)), "decision": F.when(i % 5 == 0, "DEFER")})


@query("report_filter_sort", GROUPS_SQL + "SELECT group_id, file_count, sort_path, confidence FROM gs WHERE status = 'REVIEW_REQUIRED' AND decision IS NULL AND confidence >= 0.25::DOUBLE ORDER BY coalesce(confidence, -1) DESC, group_id")
def report_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.filter_groups(open_groups(spark, sf_dir), least_confidence=0.25, unresolved=True)
    return reports.sort_groups(found, "confidence").select("group_id", "file_count", "sort_path", "confidence")


@query("catalog_revision", GROUPS_SQL + "SELECT 'rev_' || substr(sha256('scan_7' || chr(10) || coalesce(string_agg(group_id || ':' || status || ':' || coalesce(confidence::VARCHAR, '-'), '|' ORDER BY group_id), '') || chr(10) || '41'), 1, 24) AS revision FROM gs")
def catalog_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.catalog_revision("scan_7", open_groups(spark, sf_dir), 41)


@query("group_reasons", MEMBERS_SQL + f"""SELECT group_id, CASE WHEN count(x) = 0 THEN '{reports.NO_EVIDENCE}' WHEN bool_or(x IN (0, 1)) THEN '{reports.CONFLICTING}' WHEN bool_or(x = 2) THEN '{reports.PROBABLE}' ELSE '{reports.ALL_STRONG}' END AS reason
FROM (SELECT group_id, CASE WHEN group_id % 11 <> 0 THEN file_id % 9 END AS x FROM m) GROUP BY group_id""")
def group_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, x = members(spark, sf_dir), F.col("file_id") % 9
    name = F.when(x == 0, "DIFFERENT").when(x == 1, "CONFLICT").when(x == 2, "PROBABLE").when(x % 2 == 0, "EXACT").otherwise("AUDIO_EQUIVALENT")
    return reports.group_reasons(m.where("group_id % 11 <> 0").select("group_id", name.alias("classification")), m.select("group_id").distinct())


@query("split_spanning_groups", MEMBERS_SQL + "SELECT group_id FROM m WHERE file_id % 3 <> 2 GROUP BY group_id HAVING bool_or(file_id % 3 = 0) AND bool_or(file_id % 3 = 1)")
def split_spanning_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir).select("group_id", "file_id")
    return decisions.spanning_groups(m, m.where("file_id % 3 = 0"), m.where("file_id % 3 = 1"))


@query("decision_validation", GROUPS_SQL + """, ds AS (SELECT doc_id AS group_id, ['CONFIRM', 'CHANGE_PREFERRED', 'REJECT', 'DEFER'][1 + doc_id % 4] AS decision, CASE WHEN doc_id % 4 = 1 OR doc_id % 8 = 0 THEN doc_id + (doc_id // 4) % 3 END AS best FROM documents)
SELECT ds.group_id, ds.decision, CASE WHEN gs.group_id IS NULL THEN 'UNKNOWN_GROUP' WHEN best IS NOT NULL AND f.doc_id IS NULL THEN 'UNKNOWN_FILE' WHEN status <> 'REVIEW_REQUIRED' THEN 'ALREADY_RESOLVED'
  WHEN ds.decision = 'CHANGE_PREFERRED' AND m.file_id IS NULL THEN 'NOT_A_MEMBER' WHEN ds.decision = 'CHANGE_PREFERRED' AND best % 6 = 1 THEN 'NO_ACTIVE_TRACK' WHEN ds.decision = 'CONFIRM' AND ds.group_id % 7 = 0 THEN 'NOTHING_PROPOSED' END AS failure
FROM ds LEFT JOIN gs USING (group_id) LEFT JOIN documents f ON f.doc_id = best LEFT JOIN m ON m.file_id = best AND m.group_id = ds.group_id""")
def decision_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    action = F.element_at(F.array(*map(F.lit, decisions.ACTIONS)), (i % 4 + 1).cast("int"))
    given = d.select(i.alias("group_id"), action.alias("decision"), F.when((i % 4 == 1) | (i % 8 == 0), i + F.floor(i / 4) % 3).alias("preferred_file_id"))
    groups = open_groups(spark, sf_dir).select("group_id", "status", F.when(F.col("group_id") % 7 != 0, F.col("group_id")).alias("proposed_preferred_file_id"))
    files = d.select(i.alias("file_id"), (i % 6 != 1).alias("linked"))
    return decisions.first_failures(given, groups, members(spark, sf_dir), files).select("group_id", "decision", "failure")


# Journal, from events ---------------------------------------------------------------------------


@query("watermark_gap", "SELECT max(event_id) + 1 AS next_sequence, (count(*) FILTER (WHERE event_id > 900))::BIGINT AS pending, max(event_id) = 900 AS ok FROM events")
def watermark_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.journal_state(table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence")), 900)


@query("provenance", "SELECT event_id FROM events WHERE user_id = 3 OR event_id % 97 = 5")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("track_id"), F.col("event_id").alias("file_id"))
    return reports.track_events(e, spark.range(3, 4).select(F.col("id").alias("track_id")), e.where("event_id % 97 = 5").select("file_id")).select("event_id")


@query("replay_state", """
WITH e AS (SELECT 'trk_' || user_id AS track_id, CASE event_type WHEN 'click' THEN 'artist' WHEN 'view' THEN 'title' ELSE 'version' END AS field, CASE WHEN event_id % 10 <> 0 THEN 'v' || event_id END AS value, event_id FROM events)
SELECT track_id, field, first(value ORDER BY event_id DESC) AS value FROM e GROUP BY track_id, field""")
def replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of all tracks after the whole journal."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    payload = F.struct(
        F.concat(F.lit("trk_"), user).alias("track_public_id"),
        F.array(F.concat(F.lit("f/"), user)).alias("track_relative_paths"),
        F.when(kind == "click", "artist").when(kind == "view", "title").otherwise("version").alias("field"),
        F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("value"),
    )
    e = table(spark, sf_dir, "events")
    events = e.select(F.col("event_id").alias("sequence"), F.lit(replay.OVERRIDE).alias("event_type"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))
    links = e.select(F.concat(F.lit("f/"), user).alias("relative_path"), F.concat(F.lit("scanned_"), user).alias("track_id")).distinct()
    return replay.replay(links, events).overrides


# Output of tools, from part --------------------------------------------------------------------


@query("probe_parse", """SELECT p_partkey AS file_id, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'codec' || p_size END AS codec, CASE WHEN p_partkey % 10 = 0 OR p_partkey % 4 = 0 THEN NULL ELSE 44100 + p_size END::BIGINT AS sample_rate,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size * 1000 + 500 END::BIGINT AS duration_ms, CASE WHEN p_partkey % 10 = 0 THEN 'no audio stream' WHEN p_partkey % 6 = 0 THEN 'no duration' END AS error FROM part""")
def probe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    audio = F.struct(F.when(key % 10 == 0, "video").otherwise("audio").alias("codec_type"), F.concat(F.lit("codec"), size.cast("string")).alias("codec_name"), F.when(key % 4 == 0, "0").otherwise((size + 44100).cast("string")).alias("sample_rate"))
    text = F.to_json(F.struct(F.struct(F.when(key % 6 != 0, F.concat(size.cast("string"), F.lit(".5"))).alias("duration")).alias("format"), F.array(audio).alias("streams")))
    return table(spark, sf_dir, "part").select(key.alias("file_id"), adapters.read_probe(text).alias("p")).select("file_id", "p.codec", "p.sample_rate", "p.duration_ms", "p.error")


@query("level_stats", """SELECT p_partkey AS file_id, -(p_size % 3) / 4.0::DOUBLE AS peak_db, p_size % 3 < 2 AND p_partkey % 100 > 10 AND p_partkey % 5 <> 0 AS clipped, p_size / 2.0::DOUBLE AS attenuation_db FROM part""")
def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    peak = (-(size % 3) / F.lit(4.0)).cast("string")
    err = F.concat(F.lit("[Parsed_astats_0 @ 0x1] Peak level dB: -99\n[Parsed_astats_0 @ 0x1] Peak level dB: "), peak, F.lit("\nother line\n[Parsed_astats_0 @ 0x1] Abs Peak count: "), (key % 100).cast("string"), F.lit("\n[Parsed_astats_0 @ 0x1] Number of samples: "), F.when(key % 5 == 0, "n/a").otherwise("100"))
    low = F.concat(F.lit("[Parsed_astats_1 @ 0x2] RMS level dB: "), (size - 30).cast("string"))
    high = F.concat(F.lit("[Parsed_astats_1 @ 0x2] RMS level dB: "), (size / F.lit(2.0) - 30).cast("string"))
    return table(spark, sf_dir, "part").select(key.alias("file_id"), adapters.level(err, "Peak level dB").alias("peak_db"), adapters.is_clipped(err).alias("clipped"), adapters.attenuation(low, high).alias("attenuation_db"))
