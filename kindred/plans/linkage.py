"""Queries for names, candidate tiers, evidence, quality and groups, over records made from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import evidence as E
from kindred.functions import fingerprint as FP
from kindred.functions import quality as Q
from kindred.functions import text as X
from kindred.operators import candidates, groups
from kindred.plans.catalogue import RECORDS_SQL, WEAK, query, records, table

# Names -----------------------------------------------------------------------------------

NAMES_SQL = """
WITH n AS (SELECT p_partkey AS file_id, CASE p_partkey % 5 WHEN 0 THEN '01 - ' || p_brand || ' - ' || p_name || ' (' || p_type || ' Remix).flac'
  WHEN 1 THEN p_brand || ' – ' || p_name || '.mp3' WHEN 2 THEN p_name || '.wav' WHEN 3 THEN '3. ' || p_brand || ' - ' || p_name || ' [2009 Remastered] (' || p_size || ') (Live).aiff'
  ELSE p_brand || ' - ' || p_name || ' - x.mp3' END AS name,
  CASE p_partkey % 4 WHEN 0 THEN p_brand || ' feat. ' || p_type || ' & ' || p_type WHEN 1 THEN p_brand || ' (ft ' || p_type || ')' WHEN 2 THEN p_brand || ' Featuring: ' || p_type || ', ' || p_type || ' and X' ELSE p_brand || ' Feature' END AS artist FROM part),
s AS (SELECT file_id, regexp_replace(replace(regexp_replace(name, '\\.[^.]+$', ''), '–', '-'), '^\\d{1,3}\\s*[-.]\\s*', '') AS stem FROM n),
p AS (SELECT file_id, CASE WHEN len(parts) = 2 THEN trim(parts[1]) END AS artist, CASE WHEN len(parts) = 2 THEN trim(parts[2]) END AS rest FROM (SELECT file_id, string_split_regex(stem, '\\s+-\\s+') AS parts FROM s))
"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = (
        F.when(key % 5 == 0, F.concat(F.lit("01 - "), "p_brand", F.lit(" - "), "p_name", F.lit(" ("), "p_type", F.lit(" Remix).flac")))
        .when(key % 5 == 1, F.concat("p_brand", F.lit(" – "), "p_name", F.lit(".mp3")))
        .when(key % 5 == 2, F.concat("p_name", F.lit(".wav")))
        .when(key % 5 == 3, F.concat(F.lit("3. "), "p_brand", F.lit(" - "), "p_name", F.lit(" [2009 Remastered] ("), size, F.lit(") (Live).aiff")))
        .otherwise(F.concat("p_brand", F.lit(" - "), "p_name", F.lit(" - x.mp3")))
    )
    artist = (
        F.when(key % 4 == 0, F.concat("p_brand", F.lit(" feat. "), "p_type", F.lit(" & "), "p_type"))
        .when(key % 4 == 1, F.concat("p_brand", F.lit(" (ft "), "p_type", F.lit(")")))
        .when(key % 4 == 2, F.concat("p_brand", F.lit(" Featuring: "), "p_type", F.lit(", "), "p_type", F.lit(" and X")))
        .otherwise(F.concat("p_brand", F.lit(" Feature")))
    )
    return table(spark, sf_dir, "part").select(key.alias("file_id"), name.alias("name"), artist.alias("artist"))


@query("filename_parse", NAMES_SQL + """
SELECT file_id, artist, trim(regexp_replace(regexp_replace(rest, '[(\\[][^()\\[\\]]*(Remix|Live)[)\\]]', ''), '\\s*\\[2009 Remastered\\]\\s*', ' ')) AS title,
  nullif(regexp_extract(rest, '[(\\[]([^()\\[\\]]*(Remix|Live))[)\\]]', 1), '') AS version, nullif(regexp_extract(rest, '2009 Remastered'), '') AS edition FROM p
""")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("file_id", X.parse_filename(F.col("name")).alias("p")).select("file_id", "p.*")


@query("featured_split", NAMES_SQL + """
SELECT file_id, CASE WHEN file_id % 4 = 3 THEN artist ELSE regexp_extract(artist, '^(.*?)\\s*\\(?(feat\\.|ft|Featuring:)\\s', 1) END AS primary_artist,
  CASE WHEN file_id % 4 = 3 THEN '' ELSE regexp_replace(trim(regexp_extract(artist, '(feat\\.|ft|Featuring:)\\s+(.*?)\\)?$', 2)), '\\s*(,|&|\\band\\b)\\s*', '|', 'g') END AS featured FROM n
""")
def featured_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = names(spark, sf_dir).select("file_id", X.split_featured(F.col("artist")).alias("s"))
    return s.select("file_id", F.col("s.primary").alias("primary_artist"), F.array_join("s.featured", "|").alias("featured"))


@query("resolve_prefer", NAMES_SQL + "SELECT p.file_id, CASE WHEN p_type <> '' AND file_id % 3 = 0 THEN p_type ELSE artist END AS artist, CASE WHEN file_id % 3 = 0 THEN 'TAG' WHEN artist IS NULL THEN 'UNKNOWN' ELSE 'FILENAME' END AS artist_source FROM p JOIN part ON file_id = p_partkey")
def resolve_prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise("  ").alias("tag"))
    j = names(spark, sf_dir).join(tags, "file_id")
    tag, name = X.valid(F.col("tag")), X.valid(X.parse_filename(F.col("name"))["artist"])
    return j.select("file_id", F.coalesce(tag, name).alias("artist"), F.when(tag.isNotNull(), "TAG").when(name.isNotNull(), "FILENAME").otherwise("UNKNOWN").alias("artist_source"))


@query("normalize_identity", NAMES_SQL + "SELECT file_id, trim(regexp_replace(lower(replace(replace(name, '–', '-'), '\"', '')), '\\s+', ' ', 'g')) AS normal FROM n")
def normalize_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("file_id", X.normalize_identity(F.col("name")).alias("normal"))


@query("featured_jaccard", "WITH t AS (SELECT p_partkey AS file_id, list_distinct(string_split(lower(p_name), ' ')) AS a, CASE WHEN p_partkey % 5 = 0 THEN [] ELSE list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) END AS b FROM part) SELECT file_id, CASE WHEN len(b) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM t")
def featured_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.split(F.lower("p_name"), " ")
    b = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.round(X.jaccard(a, b), 6).alias("jaccard"))


# Tiers and evidence ------------------------------------------------------------------------

BAND = "l.artist = r.artist AND l.artist <> '' AND l.title <> '' AND r.title <> '' AND l.file_id < r.file_id AND abs(l.duration_ms - r.duration_ms) <= greatest(l.tol, r.tol)"
TIER_SQL = RECORDS_SQL.replace("WITH f", "WITH RECURSIVE f", 1) + f"""
, names AS (SELECT DISTINCT least(l.title, r.title) AS a, greatest(l.title, r.title) AS b FROM b l JOIN b r ON {BAND} AND l.title <> r.title),
dp AS (SELECT a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS cells FROM names
  UNION ALL SELECT a, b, i + 1, [0::BIGINT] || list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN substr(a, i + 1, 1) = substr(b, k, 1) THEN cells[k] + 1 ELSE cells[k + 1] END))) FROM dp WHERE i < len(a)),
ratios AS (SELECT a, b, 200.0::DOUBLE * cells[-1] / (len(a) + len(b)) AS ratio FROM dp WHERE i = len(a)),
strong AS (SELECT l.file_id AS left_id, r.file_id AS right_id FROM b l JOIN b r ON {BAND} AND l.title = r.title),
cand AS (SELECT l.file_id AS left_id, r.file_id AS right_id, ratio FROM b l JOIN b r ON {BAND} AND l.title <> r.title JOIN ratios ON a = least(l.title, r.title) AND b = greatest(l.title, r.title) WHERE ratio >= 85),
weak AS (SELECT l.file_id AS left_id, r.file_id AS right_id FROM b l JOIN b r ON l.file_id < r.file_id AND l.title = r.title AND l.title <> '' AND ({WEAK.format(s="l", c="r")} OR {WEAK.format(s="r", c="l")})),
tiers AS (SELECT left_id, right_id, max(tier) AS tier FROM (SELECT left_id, right_id, 3 AS tier FROM strong UNION ALL SELECT left_id, right_id, 2 FROM cand UNION ALL SELECT left_id, right_id, 1 FROM weak) GROUP BY ALL)
"""


@query("title_indel_ratio", TIER_SQL + "SELECT a, b, round(ratio, 6) AS ratio FROM ratios")
def title_indel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.title_ratios(records(spark, sf_dir)).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query("blocking_candidate_pairs", TIER_SQL + "SELECT left_id, right_id, round(ratio, 6) AS ratio FROM cand")
def blocking_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.candidate_pairs(records(spark, sf_dir)).select("left_id", "right_id", F.round("ratio", 6).alias("ratio"))


@query("blocking_best_tier", TIER_SQL + "SELECT left_id, right_id, tier FROM tiers")
def blocking_best_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.best_tier(records(spark, sf_dir))


EVIDENCE_SQL = TIER_SQL + """
, e AS (SELECT left_id, right_id, CASE WHEN coalesce(l.artist, '') = coalesce(r.artist, '') THEN 1.0::DOUBLE ELSE 0.0 END AS artist_similarity, CASE WHEN l.title = r.title THEN 1.0::DOUBLE ELSE ratio / 100 END AS title_similarity,
  CASE WHEN coalesce(l.version, '') = coalesce(r.version, '') THEN 'COMPATIBLE' WHEN l.version IS NOT NULL AND r.version IS NOT NULL THEN 'INCOMPATIBLE' ELSE 'COMPATIBLE_WEAK' END AS version_state,
  abs(l.duration_ms - r.duration_ms) AS duration_delta_ms, l.duration_ms = r.duration_ms AND left_id % 3 = right_id % 3 AS same_bytes, 0.9::DOUBLE + ((left_id * 7 + right_id * 3) % 101) / 1000.0::DOUBLE AS sound
  FROM tiers JOIN b l ON l.file_id = left_id JOIN b r ON r.file_id = right_id LEFT JOIN ratios ON a = least(l.title, r.title) AND b = greatest(l.title, r.title)),
c AS (SELECT left_id, right_id, CASE WHEN same_bytes THEN 'EXACT' WHEN version_state = 'INCOMPATIBLE' AND sound >= 0.93::DOUBLE THEN 'CONFLICT' WHEN version_state <> 'INCOMPATIBLE' AND sound >= 0.985::DOUBLE THEN 'AUDIO_EQUIVALENT' WHEN sound >= 0.93::DOUBLE THEN 'PROBABLE' ELSE 'DIFFERENT' END AS classification, sound FROM e),
d AS (SELECT left_id, right_id, classification, CASE classification WHEN 'EXACT' THEN 1.0::DOUBLE WHEN 'DIFFERENT' THEN 1.0 - sound ELSE sound END AS confidence FROM c),
hops AS (SELECT left_id AS u, right_id AS v FROM tiers UNION ALL SELECT right_id, left_id FROM tiers),
reach AS (SELECT u AS file_id, u AS seen FROM hops UNION SELECT reach.file_id, v FROM reach JOIN hops ON u = seen),
comps AS (SELECT file_id, min(seen) AS group_id FROM reach GROUP BY file_id)
"""


COMPARED = ("artist", "title", "version", "duration_ms")


def with_evidence(pairs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with evidence from their records."""
    side = lambda p, key: records(spark, sf_dir).select(F.col("file_id").alias(key), *(F.col(c).alias(p + c) for c in COMPARED))
    return evidence(pairs.join(side("l_", "left_id"), "left_id").join(side("r_", "right_id"), "right_id"), *pairs.columns)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the tiers with evidence. Where ids are repeated, pairs are gathered first and then meet their records."""
    r = records(spark, sf_dir)
    if candidates.repeated_ids(r):
        return with_evidence(candidates.best_tier(r), spark, sf_dir)
    return evidence(candidates.compared(r, ("version", "duration_ms")), "left_id", "right_id")


def evidence(pairs: DataFrame, *columns: str) -> DataFrame:
    """Evidence of pairs with both records' columns; equal bytes and the similarity of sound stand for what adapters supply."""
    left, right = F.col("left_id"), F.col("right_id")
    known = "title_similarity" in pairs.columns
    return pairs.select(
        *columns,
        (F.col("artist_similarity") if known else X.similarity(F.col("l_artist"), F.col("r_artist"))).alias("artist_similarity"),
        (F.col("title_similarity") if known else X.similarity(F.col("l_title"), F.col("r_title"))).alias("title_similarity"),
        E.version_compatibility(F.col("l_version"), F.col("r_version")).alias("version_state"),
        F.abs(F.col("l_duration_ms") - F.col("r_duration_ms")).alias("duration_delta_ms"),
        ((F.col("l_duration_ms") == F.col("r_duration_ms")) & (left % 3 == right % 3)).alias("same_bytes"),
        (F.lit(0.9) + (left * 7 + right * 3) % 101 / F.lit(1000.0)).alias("sound"),
    )


def classified(pairs: DataFrame) -> DataFrame:
    c = E.classify(F.col("same_bytes"), F.col("version_state"), F.col("sound"))
    return pairs.withColumn("c", c).select("*", "c.classification", "c.confidence").drop("c")


@query("pair_evidence", EVIDENCE_SQL + "SELECT left_id, right_id, version_state, duration_delta_ms, round((0.5::DOUBLE * artist_similarity + 0.4::DOUBLE * title_similarity) / 0.9::DOUBLE, 6) AS similarity FROM e")
def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = compared(spark, sf_dir)
    s = E.composite_similarity(F.col("artist_similarity"), F.col("title_similarity"), F.lit(None).cast("double"))
    return e.select("left_id", "right_id", "version_state", "duration_delta_ms", F.round(s, 6).alias("similarity"))


@query("pair_classification", EVIDENCE_SQL + "SELECT left_id, right_id, classification, round(confidence, 6) AS confidence FROM d")
def pair_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = classified(compared(spark, sf_dir))
    return e.select("left_id", "right_id", "classification", F.round("confidence", 6).alias("confidence"))


@query("pair_class_counts", EVIDENCE_SQL + "SELECT value, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['EXACT', 'AUDIO_EQUIVALENT', 'PROBABLE', 'DIFFERENT', 'CONFLICT']) AS value) LEFT JOIN (SELECT classification AS value, count(*) AS n FROM d GROUP BY 1) USING (value)")
def pair_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = classified(compared(spark, sf_dir))
    return groups.zero_filled(e, "classification", E.CLASSES)


# Groups --------------------------------------------------------------------------------------


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.connected_components(candidates.linking_pairs(records(spark, sf_dir)))


@query("candidate_components", EVIDENCE_SQL + "SELECT file_id, group_id FROM comps")
def candidate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir)


@query("member_all_pairs", EVIDENCE_SQL + "SELECT x.group_id, x.file_id AS left_id, y.file_id AS right_id FROM comps x JOIN comps y ON x.group_id = y.group_id AND x.file_id < y.file_id")
def member_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.member_pairs(components(spark, sf_dir))


@query("group_status", EVIDENCE_SQL + """
, every AS (SELECT x.group_id, x.file_id AS left_id, y.file_id AS right_id, l.duration_ms = r.duration_ms AND x.file_id % 3 = y.file_id % 3 AS same_bytes, coalesce(l.version <> r.version, FALSE) AS clash, 0.9::DOUBLE + ((x.file_id * 7 + y.file_id * 3) % 101) / 1000.0::DOUBLE AS sound
  FROM comps x JOIN comps y ON x.group_id = y.group_id AND x.file_id < y.file_id JOIN b l ON l.file_id = x.file_id JOIN b r ON r.file_id = y.file_id)
SELECT group_id, CASE WHEN bool_or(NOT same_bytes AND (clash OR sound < 0.985::DOUBLE)) THEN 'REVIEW_REQUIRED' ELSE 'AUTO_CONFIRMED' END AS status,
  round(min(CASE WHEN same_bytes THEN 1.0::DOUBLE WHEN sound < 0.93::DOUBLE THEN 1.0 - sound ELSE sound END), 6) AS confidence FROM every GROUP BY group_id""")
def group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a group is that of all pairs of its members, linked or not."""
    pairs = groups.member_pairs(components(spark, sf_dir).join(records(spark, sf_dir).select("file_id", *COMPARED), "file_id"))
    return groups.group_status(classified(evidence(pairs, "group_id"))).withColumn("confidence", F.round("confidence", 6))


@query("fingerprint_similarity", """
WITH f AS (SELECT p_partkey AS k, list_transform(range(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 20 + p_partkey % 9 END), lambda i: ((i + p_partkey % 4) * 48271 + CASE WHEN i % 5 = 0 THEN p_partkey % 16 ELSE 0 END) % 65536) AS v FROM part),
p AS (SELECT l.k AS left_id, r.k AS right_id, l.v AS lv, r.v AS rv FROM f l JOIN f r ON r.k = l.k + 1),
i AS (SELECT left_id, lv, rv, unnest(range(len(lv))) AS i FROM p), ij AS (SELECT *, unnest(range(len(rv))) AS j FROM i),
n AS (SELECT left_id, j - i AS shift, count(*) AS n FROM ij WHERE j - i BETWEEN -120 AND 119 AND bit_count(xor(lv[i + 1], rv[j + 1])) <= 2 GROUP BY ALL),
m AS (SELECT left_id, max(n) AS n FROM n GROUP BY left_id)
SELECT left_id, right_id, round(coalesce(CASE WHEN len(lv) > 0 AND len(rv) > 0 THEN n::DOUBLE / least(len(lv), len(rv)) END, 0.0), 6) AS score FROM p LEFT JOIN m USING (left_id)""")
def fingerprint_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    n = F.when(key % 11 == 0, 0).otherwise(20 + key % 9)
    cell = lambda i: ((i + key % 4) * 48271 + F.when(i % 5 == 0, key % 16).otherwise(0)) % 65536
    f = table(spark, sf_dir, "part").select(key.alias("k"), F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), cell)).otherwise(F.array().cast("array<bigint>")).alias("v"))
    left, right = f.select(F.col("k").alias("left_id"), F.col("v").alias("lv")), f.select((F.col("k") - 1).alias("left_id"), F.col("k").alias("right_id"), F.col("v").alias("rv"))
    return left.join(right, "left_id").select("left_id", "right_id", F.round(FP.alignment_score(F.col("lv"), F.col("rv")), 6).alias("score"))


# Quality ---------------------------------------------------------------------------------------

QUALITY_SQL = """
, q0 AS (SELECT p_partkey AS file_id, CASE p_partkey % 5 WHEN 0 THEN 'flac' WHEN 1 THEN 'mp3' WHEN 2 THEN 'pcm_s16le' WHEN 3 THEN 'aac' ELSE 'adpcm' END AS codec, CASE WHEN p_partkey % 2 = 0 THEN 'wav' ELSE 'ogg' END AS container,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 32000 WHEN 2 THEN 0 ELSE 48000 END AS sample_rate, (p_partkey % 3) * 8 AS bit_depth, p_size * 8000 AS bitrate, (p_partkey % 250) / 10.0::DOUBLE AS attenuation, p_partkey % 9 = 0 AS clipped, p_partkey % 17 <> 0 AS intact,
  ((p_partkey % 2) + (p_partkey % 7 > 0)::INT + 2) / 6.0::DOUBLE AS complete FROM part),
q1 AS (SELECT *, codec IN ('flac', 'pcm_s16le') OR (codec = 'adpcm' AND container = 'wav') AS lossless FROM q0),
q2 AS (SELECT *, CASE WHEN NOT lossless OR coalesce(sample_rate, 0) < 40000 OR attenuation < 8 THEN 'NONE' WHEN attenuation < 12 THEN 'LOW' WHEN attenuation < 16 THEN 'MEDIUM' ELSE 'HIGH' END AS suspicion,
  CASE WHEN lossless THEN 100.0::DOUBLE * least(1.0::DOUBLE, coalesce(nullif(sample_rate, 0), 44100) / 44100.0::DOUBLE, coalesce(nullif(bit_depth, 0), 16) / 16.0::DOUBLE) ELSE least(90.0::DOUBLE, bitrate / 1000.0::DOUBLE / 320.0::DOUBLE * 90.0::DOUBLE) END AS resolution FROM q1),
q AS (SELECT *, CASE WHEN intact THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, resolution - CASE suspicion WHEN 'NONE' THEN 0 WHEN 'LOW' THEN 8 WHEN 'MEDIUM' THEN 25 ELSE 55 END - CASE WHEN clipped THEN 8 ELSE 0 END + complete * 3)) ELSE 0 END AS score FROM q2)
"""


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    codec = F.when(key % 5 == 0, "flac").when(key % 5 == 1, "mp3").when(key % 5 == 2, "pcm_s16le").when(key % 5 == 3, "aac").otherwise("adpcm")
    rate = F.when(key % 6 == 1, 32000).when(key % 6 == 2, 0).when(key % 6 > 2, 48000)
    fields = [F.when(key % 2 == 1, F.col("p_type")), F.when(key % 7 > 0, F.col("p_type")), F.col("p_name"), F.col("p_brand"), F.lit(""), F.lit(None).cast("string")]
    q = table(spark, sf_dir, "part").select(
        key.alias("file_id"), rate.alias("sample_rate"), ((key % 3) * 8).alias("bit_depth"), (F.col("p_size") * 8000).alias("bitrate"), (key % 250 / F.lit(10.0)).alias("attenuation"), (key % 9 == 0).alias("clipped"), (key % 17 != 0).alias("intact"),
        Q.completeness(*fields).alias("complete"), Q.is_lossless(codec, F.when(key % 2 == 0, "wav").otherwise("ogg")).alias("lossless"),
    )
    q = q.withColumn("suspicion", Q.transcode_suspicion(F.col("lossless"), F.col("sample_rate"), F.col("attenuation")))
    score = Q.composite_score(Q.resolution_score(F.col("lossless"), F.col("sample_rate"), F.col("bit_depth"), F.col("bitrate")), F.col("suspicion"), F.col("clipped"), F.col("complete"), F.col("intact"))
    return q.withColumn("score", F.round(score, 6))


@query("quality_score", "WITH z AS (SELECT 1)" + QUALITY_SQL + "SELECT file_id, lossless, suspicion, round(complete, 6) AS complete, round(score, 6) AS score FROM q")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, sf_dir).select("file_id", "lossless", "suspicion", F.round("complete", 6).alias("complete"), "score")


@query("preferred_file", EVIDENCE_SQL + QUALITY_SQL + "SELECT group_id, file_id AS preferred_file_id FROM (SELECT group_id, file_id, row_number() OVER (PARTITION BY group_id ORDER BY intact DESC, CASE suspicion WHEN 'NONE' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, round(score, 6) DESC, lossless DESC, clipped, complete DESC, file_id) AS n FROM comps JOIN q USING (file_id)) WHERE n = 1")
def preferred_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = components(spark, sf_dir).join(quality(spark, sf_dir), "file_id")
    return groups.preferred(members, Q.preference(*(F.col(c) for c in ("intact", "suspicion", "score", "lossless", "clipped", "complete"))))


# Invariants and small reports --------------------------------------------------------------------


@query("active_link_violations", "SELECT user_id AS file_id, count(*)::BIGINT AS n FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) > 1")
def active_link_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.groupBy(F.col("user_id").alias("file_id")).agg(F.count("*").alias("n")).where("n > 1")


@query("dangling_preferred", "SELECT o_orderkey AS group_id, o_custkey AS preferred_file_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 <> 3)")
def dangling_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_custkey").alias("preferred_file_id"))
    files = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("preferred_file_id"))
    return o.join(files, "preferred_file_id", "left_anti").select("group_id", "preferred_file_id")


@query("latest_quality", "SELECT user_id AS file_id, max(event_id) AS quality_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def latest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("file_id")).agg(F.max("event_id").alias("quality_id"), F.max_by("event_type", "event_id").alias("state"))


@query("error_summary", "SELECT string_agg(path, ', ' ORDER BY path) || CASE WHEN (SELECT count(*) FROM part WHERE p_partkey % 13 = 0) > 20 THEN ', ...' ELSE '' END AS summary FROM (SELECT 'f/' || p_partkey AS path FROM part WHERE p_partkey % 13 = 0 ORDER BY path LIMIT 20)")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "part").where("p_partkey % 13 = 0").select(F.concat(F.lit("f/"), F.col("p_partkey").cast("string")).alias("path"))
    paths = failed.orderBy("path").limit(21).agg(F.array_sort(F.collect_list("path")).alias("p"))
    return paths.select(F.concat(F.array_join(F.slice("p", 1, 20), ", "), F.when(F.size("p") > 20, ", ...").otherwise("")).alias("summary"))
