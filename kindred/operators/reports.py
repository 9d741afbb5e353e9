"""Tables that people read: exports, statistics, the revision of a catalogue, filters of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.operators import groups

# Fixed values ---------------------------------------------------------------------------
TRACK_STATUSES = ("PROVISIONAL", "ACTIVE", "MERGED", "SUPERSEDED")
GROUP_STATUSES = ("DETECTED", "AUTO_CONFIRMED", "REVIEW_REQUIRED", "CONFIRMED", "REJECTED", "DEFERRED")
CONFLICTING = "conflicting or contradictory pairwise evidence within this group (design Sec.16: never rely on naive transitive closure)"
PROBABLE = "at least one PROBABLE pair -- plausible but not confident enough for automatic consolidation"
ALL_STRONG = "every pairwise classification in this group is EXACT or AUDIO_EQUIVALENT"
NO_EVIDENCE = "no pairwise evidence available (fewer than two analyzed files)"
CATALOG_FIELDS = (
    "file_public_id", "relative_path", "is_present", "track_public_id", "track_status", "artist", "title", "version", "edition", "featured_artists",
    "genre", "bpm", "key", "duration_ms", "codec", "bitrate", "sample_rate", "size_bytes", "quality_score",
)
GROUP_FIELDS = ("group_public_id", "status", "confidence", "matcher_version", "file_count", "member_paths", "proposed_preferred_path", "reasons")
CALIBRATION_FIELDS = ("left_public_id", "left_relative_path", "right_public_id", "right_relative_path", "blocking_tier", "binary_hash_equal", "chromaprint_similarity", "duration_delta_ms", "version_compatibility")
TIERS = {3: "STRONG", 2: "CANDIDATE", 1: "WEAK"}
# ----------------------------------------------------------------------------------------


def named_in_order(featured: DataFrame, key: str) -> DataFrame:
    """key, featured_artists: the names by position with commas between."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"])
    return featured.groupBy(key).agg(F.array_join(names, ", ").alias("featured_artists"))


def catalog_rows(files: DataFrame, links: DataFrame, identity: DataFrame, featured: DataFrame, quality: DataFrame) -> DataFrame:
    """A row for each file: the identity of its active track, or the raw tags where it has none.

    files: file_id, artist_raw, title_raw and what else is to be kept. links: file_id,
    track_id, is_active. identity: track_id, track_status, artist, title, version,
    edition. featured: track_id, position, name. quality: id, file_id, quality_score,
    of which the latest counts.
    """
    latest = quality.groupBy("file_id").agg(F.max_by("quality_score", "id").alias("quality_score"))
    tracks = identity.join(named_in_order(featured, "track_id"), "track_id", "left")
    active = links.where("is_active").select("file_id", "track_id").join(tracks, "track_id")
    rows = files.join(active, "file_id", "left").join(latest, "file_id", "left")
    raw = F.col("track_id").isNull()
    fallback = {n: F.when(raw, F.col(f"{n}_raw")).otherwise(F.col(n)) for n in ("artist", "title")}
    return rows.withColumns(fallback | {"featured_artists": F.coalesce("featured_artists", F.lit(""))}).drop("artist_raw", "title_raw")


def counts_by(rows: DataFrame, category: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """category, metric, value with a row for each of ``values``; one aggregate, no join."""
    counts = rows.agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))
    return _long(counts, category, {v.lower(): F.col(v) for v in values})


def _long(one_row: DataFrame, category: str, metrics: dict[str, Column]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), c.cast("string").alias("value")) for m, c in metrics.items()))
    return one_row.select(F.explode(pairs).alias("p")).select(F.lit(category).alias("category"), "p.metric", F.coalesce("p.value", F.lit("-")).alias("value"))


def file_stats(files: DataFrame) -> DataFrame:
    present = F.count_if("is_present")
    return _long(files.agg(F.count("*").alias("n"), present.alias("p")), "files", {"total": F.col("n"), "present": F.col("p"), "missing": F.col("n") - F.col("p")})


def scan_stats(scans: DataFrame) -> DataFrame:
    """scans: id, public_id, status, started_at, files_failed. The latest is by start, then id."""
    last = F.max_by(F.struct("public_id", "status"), F.struct("started_at", "id"))
    one = scans.agg(F.count("*").alias("n"), F.coalesce(F.sum("files_failed"), F.lit(0)).alias("failed"), last.alias("last"))
    return _long(one, "scans", {"runs_total": F.col("n"), "failed_files_total": F.col("failed"), "latest_scan_public_id": F.col("last.public_id"), "latest_scan_status": F.col("last.status")})


def catalog_revision(latest_scan: str | None, groups: DataFrame, watermark: int) -> DataFrame:
    """One row, revision: a digest of the latest scan, all groups by id, and the watermark of the journal.

    The digest needs all groups in one text, which only a catalogue's open and resolved groups enter, not its records.
    """
    text = F.concat_ws(":", "group_id", "status", F.coalesce(F.col("confidence").cast("string"), F.lit("-")))
    state = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_id", text.alias("text")))), lambda g: g["text"]), "|")
    whole = F.concat_ws("\n", F.lit(latest_scan or "scan_none"), state, F.lit(str(watermark)))
    return groups.agg(F.concat(F.lit("rev_"), F.substring(F.sha2(whole, 256), 1, 24)).alias("revision"))


def group_reasons(evidence: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, reason for each of ``groups`` from the classes of its pairs."""
    has = lambda *names: F.bool_or(F.col("classification").isin(*names))
    reason = F.when(has("DIFFERENT", "CONFLICT"), CONFLICTING).when(has("PROBABLE"), PROBABLE).otherwise(ALL_STRONG)
    return groups.select("group_id").join(evidence.groupBy("group_id").agg(reason.alias("reason")), "group_id", "left").select("group_id", F.coalesce("reason", F.lit(NO_EVIDENCE)).alias("reason"))


def filter_groups(rows: DataFrame, status: str | None = None, least_confidence: float | None = None, file_format: str | None = None, decision: str | None = None, unresolved: bool = False) -> DataFrame:
    """Groups of a review. rows: status, confidence, formats (array), decision (null: UNDECIDED)."""
    out = rows
    if unresolved:
        out = out.where("status = 'REVIEW_REQUIRED' and decision is null")
    if status:
        out = out.where(F.col("status") == status)
    if least_confidence is not None:
        out = out.where(F.col("confidence") >= least_confidence)
    if file_format:
        out = out.where(F.array_contains("formats", file_format))
    if decision:
        out = out.where(F.col("decision").isNull() if decision == "UNDECIDED" else F.col("decision") == decision)
    return out


def sort_groups(groups: DataFrame, key: str, descending: bool = True) -> DataFrame:
    """By confidence, quality_delta, file_count or sort_path; no number counts as -1, no path as empty, ties go by id."""
    c = F.coalesce(F.col(key), F.lit("" if key == "sort_path" else -1))
    return groups.orderBy(c.desc() if descending else c.asc(), "group_id")


def track_events(events: DataFrame, tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Events of given tracks or of given files, each once: two semi-joins, not a join on either."""
    by_track = events.join(tracks.select("track_id"), "track_id", "left_semi")
    by_file = events.join(files.select("file_id"), "file_id", "left_semi").join(tracks.select("track_id"), "track_id", "left_anti")
    return by_track.unionByName(by_file)


def journal_state(events: DataFrame, watermark: int) -> DataFrame:
    """One row: next_sequence, pending events, and ok where the journal has all of them."""
    top = F.coalesce(F.max("sequence"), F.lit(0))
    return events.agg((top + 1).alias("next_sequence"), F.count_if(F.col("sequence") > watermark).alias("pending"), (top == watermark).alias("ok"))


def numbered(pending: DataFrame, after: int) -> DataFrame:
    """Gap-free sequence numbers behind ``after`` in the order of recorded_at, event_uuid.

    Rows are dealt by ranges of that order, numbered within each range, and raised
    by the sizes of the ranges before, which alone go to the driver.
    """
    parts = pending.withColumn("_order", F.struct("recorded_at", "event_uuid"))
    groups.checkpoint_folder(pending.sparkSession)
    dealt = parts.repartitionByRange("_order").withColumn("_part", F.spark_partition_id()).checkpoint()
    offset, offsets = after, []
    for r in dealt.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((r["_part"], offset))
        offset += r["count"]
    starts = F.create_map(*(F.lit(x) for pair in offsets for x in pair)) if offsets else F.create_map(F.lit(0), F.lit(after))
    w = Window.partitionBy("_part").orderBy("_order")
    return dealt.withColumn("sequence", F.row_number().over(w).cast("long") + F.element_at(starts, F.col("_part"))).drop("_order", "_part")


def calibration(pairs: DataFrame) -> DataFrame:
    """Pairs for a look at thresholds; the similarity of sound is text with four decimals, empty for equal bytes."""
    sound = F.when(F.col("same_bytes") | F.col("sound").isNull(), "").otherwise(F.format_string("%.4f", "sound"))
    return pairs.withColumn("sound", sound)


def manifest_groups(groups: DataFrame, files: DataFrame, pairs: DataFrame) -> DataFrame:
    """group_id, entry: the JSON of each group of a review with its records and pairs.

    files: group_id, file_id, relative_path, quality_score and what else a record
    shows. pairs: group_id, left_file_id, right_file_id and their evidence.
    """
    entry = F.struct(*(F.col(c) for c in sorted(files.columns) if c != "group_id"))
    listed = files.groupBy("group_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("file_id").alias("k"), entry.alias("e")))), lambda x: x["e"]).alias("files"),
        F.count("*").alias("file_count"),
        F.min("relative_path").alias("sort_path"),
        (F.max("quality_score") - F.min("quality_score")).alias("quality_delta"),
    )
    evidence = F.struct(*(F.col(c) for c in sorted(pairs.columns) if c != "group_id"))
    compared = pairs.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("left_file_id", "right_file_id", evidence.alias("e")))), lambda x: x["e"]).alias("pairs"))
    whole = groups.join(listed, "group_id", "left").join(compared, "group_id", "left").join(group_reasons(pairs, groups), "group_id")
    whole = whole.withColumns({"pairs": F.coalesce("pairs", F.array()), "files": F.coalesce("files", F.array()), "file_count": F.coalesce("file_count", F.lit(0)), "reasons": F.array("reason")}).drop("reason")
    return whole.select("group_id", F.to_json(F.struct(*(F.col(c) for c in sorted(whole.columns))), {"ignoreNullFields": "false"}).alias("entry"))


def catalog_export(files: DataFrame, links: DataFrame, identity: DataFrame, featured: DataFrame, quality: DataFrame) -> DataFrame:
    """The catalogue's 19 columns. files: those of ``catalog_rows`` with relative_path, is_present, raw tags and technical columns."""
    rows = catalog_rows(files, links, identity, featured, quality)
    names = {"file_public_id": "file_id", "track_public_id": "track_id", "genre": "genre_raw", "bpm": "bpm_raw", "key": "key_raw"}
    return rows.select(*(F.col(names.get(c, c)).alias(c) for c in CATALOG_FIELDS))


def groups_export(rows: DataFrame, members: DataFrame, files: DataFrame, pairs: DataFrame) -> DataFrame:
    """The 8 columns of a list of groups.

    rows: group_id, status, confidence, matcher_version, proposed_preferred_file_id.
    members: group_id, file_id. files: file_id, relative_path. pairs: group_id, classification.
    """
    listed = members.join(files.select("file_id", "relative_path"), "file_id").groupBy("group_id").agg(F.count("*").alias("file_count"), F.array_join(F.array_sort(F.collect_list("relative_path")), " | ").alias("member_paths"))
    best = members.join(files.select("file_id", F.col("relative_path").alias("proposed_preferred_path")), "file_id").select("group_id", F.col("file_id").alias("proposed_preferred_file_id"), "proposed_preferred_path")
    out = rows.join(listed, "group_id", "left").join(best, ["group_id", "proposed_preferred_file_id"], "left").join(group_reasons(pairs, rows), "group_id")
    out = out.withColumns({"file_count": F.coalesce("file_count", F.lit(0)), "member_paths": F.coalesce("member_paths", F.lit(""))})
    names = {"group_public_id": "group_id", "reasons": "reason"}
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in GROUP_FIELDS))


def calibration_export(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """The 9 columns for a look at thresholds. pairs: left_id, right_id, tier, same_bytes, sound, duration_delta_ms, version_state."""
    tier = F.lit(None).cast("string")
    for k, v in TIERS.items():
        tier = F.when(F.col("tier") == k, v).otherwise(tier)
    side = lambda s: files.select(F.col("file_id").alias(f"{s}_id"), F.col("public_id").alias(f"{s}_public_id"), F.col("relative_path").alias(f"{s}_relative_path"))
    out = calibration(pairs).join(side("left"), "left_id").join(side("right"), "right_id")
    names = {"blocking_tier": tier, "binary_hash_equal": F.col("same_bytes"), "chromaprint_similarity": F.col("sound"), "version_compatibility": F.col("version_state")}
    return out.select(*(names.get(c, F.col(c)).alias(c) for c in CALIBRATION_FIELDS))


def pair_stats(pairs: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """category, metric, value of the pairs by class."""
    return counts_by(pairs, "pairs", "classification", classes)


def controls(rows: DataFrame) -> DataFrame:
    """One row, formats and statuses: what a review can be filtered by, in order."""
    formats = rows.select(F.explode("formats").alias("x")).where("x is not null").distinct().withColumn("kind", F.lit("formats"))
    statuses = rows.select(F.col("status").alias("x")).where("x is not null").distinct().withColumn("kind", F.lit("statuses"))
    both = formats.unionByName(statuses).agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("x")))).alias(k) for k in ("formats", "statuses")))
    return both
