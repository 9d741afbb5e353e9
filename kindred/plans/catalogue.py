"""The catalogue's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import blocking, journal, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("exact_duplicates", "SELECT a.doc_id AS left_id, b.doc_id AS right_id, sha256(a.text) AS digest FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    left, right = d.withColumnRenamed("doc_id", "left_id"), d.withColumnRenamed("doc_id", "right_id")
    return left.join(right, "digest").where("left_id < right_id").select("left_id", "right_id", "digest")


# Records with blocking keys, from part -------------------------------------------------

RECORDS_SQL = """
WITH f AS (SELECT p_partkey AS file_id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE lower(p_brand) END AS artist, p_name AS title,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE lower(p_type) END AS version, CAST(p_size * 15000 + (p_partkey % 7) * 700 AS BIGINT) AS duration_ms FROM part),
r AS (SELECT *, CASE WHEN duration_ms <= 300000 THEN 2000 WHEN duration_ms <= 600000 THEN 3000 ELSE 5000 END AS tol FROM f),
b AS (SELECT *, greatest(1000, tol // 2) AS wtol FROM r)
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, artist, title, version, duration_ms with the tolerances of its duration."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    out = p.select(
        key.alias("file_id"),
        F.when(key % 11 != 0, F.lower("p_brand")).alias("artist"),
        F.col("p_name").alias("title"),
        F.when(key % 3 != 0, F.lower("p_type")).alias("version"),
        (F.col("p_size") * 15000 + (key % 7) * 700).cast("long").alias("duration_ms"),
    )
    return blocking.with_tolerance(out)


@query("duration_bucket", RECORDS_SQL + "SELECT file_id, tol::BIGINT AS tolerance_ms, wtol::BIGINT AS weak_tolerance_ms FROM b")
def duration_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("file_id", F.col("tol").alias("tolerance_ms"), F.col("wtol").alias("weak_tolerance_ms"))


PAIR_SQL = "SELECT l.file_id AS left_id, r.file_id AS right_id FROM b l JOIN b r ON l.file_id < r.file_id AND "


@query("blocking_strong_pairs", RECORDS_SQL + PAIR_SQL + "l.artist = r.artist AND l.title = r.title AND l.artist <> '' AND l.title <> '' AND abs(l.duration_ms - r.duration_ms) <= greatest(l.tol, r.tol)")
def blocking_strong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.strong_pairs(records(spark, sf_dir))


WEAK = "(({s}.artist IS NULL OR {s}.artist = '' OR {c}.artist IS NULL) AND abs(l.duration_ms - r.duration_ms) <= {s}.wtol)"


@query("blocking_weak_pairs", RECORDS_SQL + PAIR_SQL + "l.title = r.title AND l.title <> '' AND (" + WEAK.format(s="l", c="r") + " OR " + WEAK.format(s="r", c="l") + ")")
def blocking_weak_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.weak_pairs(records(spark, sf_dir))


# Content duplicates, from documents ------------------------------------------------------


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, digest and group_id (smallest id) of records whose content is not unique."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("digest"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    g = d.where("digest is not null").groupBy("digest").agg(F.min("file_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return d.join(g.drop("n"), "digest")


MEMBERS_SQL = "WITH d AS (SELECT doc_id AS file_id, sha256(text) AS digest, source || '/' || lang || '/' || doc_id AS path, text FROM documents), g AS (SELECT digest, min(file_id) AS group_id FROM d WHERE digest IS NOT NULL GROUP BY digest HAVING count(*) > 1), m AS (SELECT d.file_id, d.digest, d.path, g.group_id FROM d JOIN g USING (digest)) "


@query("components_exact_content", MEMBERS_SQL + "SELECT file_id, group_id FROM m")
def components_exact_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).select("file_id", "group_id")


@query("group_set_match", MEMBERS_SQL + "SELECT group_id, string_agg(file_id::VARCHAR, ',' ORDER BY file_id) AS member_key, count(*)::BIGINT AS n FROM m GROUP BY group_id")
def group_set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("file_id")), lambda x: x.cast("string")), ",").alias("member_key"), F.count("*").alias("n"))


@query("duplicate_groups_export", MEMBERS_SQL + "SELECT group_id, string_agg(path, ' | ' ORDER BY path) AS paths, min(path) AS sort_path, count(*)::BIGINT AS file_count FROM m GROUP BY group_id")
def duplicate_groups_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("path")), " | ").alias("paths"), F.min("path").alias("sort_path"), F.count("*").alias("file_count"))


# Two snapshots, from orders ---------------------------------------------------------------

SNAPSHOT_SQL = """
WITH s AS (SELECT o_orderkey AS k, 'o/' || o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, 1700000000000000000 + o_orderkey * 1000 AS mtime FROM orders),
p AS (SELECT path, CASE WHEN k % 7 = 0 THEN size + 1 ELSE size END AS size, mtime FROM s WHERE k % 10 <> 0),
c AS (SELECT path, size, mtime FROM s WHERE k % 13 <> 0),
d AS (SELECT coalesce(c.path, p.path) AS relative_path, CASE WHEN p.path IS NULL THEN 'NEW' WHEN c.path IS NULL THEN 'MISSING' WHEN c.size = p.size AND c.mtime = p.mtime THEN 'UNCHANGED' ELSE 'CHANGED' END AS change FROM c FULL OUTER JOIN p ON c.path = p.path)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("o/"), k.cast("string")).alias("relative_path"), F.floor("o_totalprice").cast("long").alias("size_bytes"), (F.lit(1700000000000000000) + k * 1000).alias("mtime_ns"))
    known = s.where(k % 10 != 0).withColumn("size_bytes", F.when(k % 7 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return known.drop("o_orderkey"), s.where(k % 13 != 0).drop("o_orderkey")


@query("scan_diff", SNAPSHOT_SQL + "SELECT relative_path, change FROM d")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.diff(*snapshots(spark, sf_dir)).select("relative_path", "change")


@query("scan_counters", SNAPSHOT_SQL + "SELECT change, count(*)::BIGINT AS n FROM d GROUP BY change")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.diff(*snapshots(spark, sf_dir)).groupBy("change").agg(F.count("*").alias("n"))


@query("stale_propagation", SNAPSHOT_SQL + "SELECT relative_path, CASE WHEN change = 'CHANGED' THEN 'STALE' WHEN change = 'NEW' THEN 'PENDING' ELSE 'CURRENT' END AS analysis_status FROM d")
def stale_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.with_analysis_status(scan.diff(*snapshots(spark, sf_dir))).select("relative_path", "analysis_status")


# Journal, from events ------------------------------------------------------------------------

JOURNAL_SQL = """
WITH j AS (SELECT event_id AS seq, user_id AS track, CASE event_type WHEN 'click' THEN 'artist' WHEN 'view' THEN 'title' WHEN 'purchase' THEN 'version' WHEN 'signup' THEN 'edition' END AS field,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS value FROM events),
o AS (SELECT *, lead(seq) OVER (PARTITION BY track, field ORDER BY seq) AS superseded_by FROM j WHERE field IS NOT NULL)
"""


def journal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"click": "artist", "view": "title", "purchase": "version", "signup": "edition"}
    field = F.lit(None).cast("string")
    for k, v in kinds.items():
        field = F.when(F.col("event_type") == k, v).otherwise(field)
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("track"), field.alias("field"), F.when(k.cast("long") % 10 != 0, k).alias("value"))


@query("override_history", JOURNAL_SQL + "SELECT seq, track, field, value, superseded_by FROM o")
def override_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.override_history(journal_events(spark, sf_dir))


IDENTITY_SQL = JOURNAL_SQL + ", a AS (SELECT * FROM o WHERE superseded_by IS NULL), p AS (SELECT track, " + ", ".join(f"count(*) FILTER (WHERE field = '{f}') > 0 AS has_{f}, max(value) FILTER (WHERE field = '{f}') AS {f}" for f in journal.FIELDS) + " FROM a GROUP BY track), b AS (SELECT c_custkey AS track, c_name AS artist, c_mktsegment AS title, CASE WHEN c_custkey % 2 = 0 THEN 'v' || c_nationkey END AS version, NULL::VARCHAR AS edition FROM customer) "


@query("effective_identity", IDENTITY_SQL + "SELECT b.track, " + ", ".join(f"CASE WHEN has_{f} THEN p.{f} ELSE b.{f} END AS {f}" for f in journal.FIELDS) + " FROM b LEFT JOIN p USING (track)")
def effective_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks from customer with the overrides from events laid over."""
    key = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(key.alias("track"), F.col("c_name").alias("artist"), F.col("c_mktsegment").alias("title"), F.when(key % 2 == 0, F.concat(F.lit("v"), F.col("c_nationkey").cast("string"))).alias("version"), F.lit(None).cast("string").alias("edition"))
    return journal.effective_identity(base, journal_events(spark, sf_dir))


@query("journal_pending", JOURNAL_SQL + "SELECT seq, track FROM j WHERE seq > (SELECT max(seq) - 17 FROM j)")
def journal_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = journal_events(spark, sf_dir)
    mark = events.agg((F.max("seq") - 17).alias("mark"))
    return events.join(F.broadcast(mark), F.col("seq") > F.col("mark")).select("seq", "track")
