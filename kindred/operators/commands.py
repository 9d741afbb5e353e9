"""What a person or a run decides, as events for the journal, and its effect on tracks and links.

An event names files by path, as ids do not outlive a rebuilding. Each command
checks what it is asked before anything is returned. Commands of one track read only
this track's rows; consolidation works on all groups at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.operators.groups import checkpoint_folder
from kindred.operators.decisions import EVENTS, first_failures, spanning_groups
from kindred.operators.replay import AUTO_PREFERRED, MERGE, OVERRIDE, SPLIT

FIELDS = ("artist", "title", "version", "edition")
#: Groups that an automatic run may still change.
ANALYZABLE = ("DETECTED", "AUTO_CONFIRMED", "REVIEW_REQUIRED")
EVENT = "event_type string, track_id string, file_id string, payload string"


class CommandError(ValueError):
    """What was asked cannot be done."""


@dataclass
class Change:
    """Rows after a command, and its events without their sequence."""

    events: DataFrame
    links: DataFrame | None = None
    tracks: DataFrame | None = None
    groups: DataFrame | None = None


def find(rows: DataFrame, column: str, *ids: str) -> DataFrame:
    """The rows with these public ids, all of which must exist."""
    out = rows.where(F.col(column).isin(*ids))
    lost = set(ids) - {r[0] for r in out.select(column).distinct().collect()}
    if lost:
        raise CommandError(f"no {column} {', '.join(sorted(lost))}")
    return out


def paths_by_track(links: DataFrame, files: DataFrame) -> DataFrame:
    """track_id, paths: of its active files, in order."""
    active = links.where("is_active").join(files.select("file_id", "relative_path"), "file_id")
    return active.groupBy("track_id").agg(F.array_sort(F.collect_list("relative_path")).alias("paths"))


def _event(rows: DataFrame, kind: str, payload: Column, track: str | None, file: str | None = None) -> DataFrame:
    """One event a row of ``rows``."""
    text = lambda c: F.col(c) if c else F.lit(None).cast("string")
    return rows.select(F.lit(kind).alias("event_type"), text(track).alias("track_id"), text(file).alias("file_id"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def _paths_of(track: str, links: DataFrame, files: DataFrame) -> DataFrame:
    """track_id, paths of one track, which may have none."""
    one = links.sparkSession.range(1).select(F.lit(track).alias("track_id"))
    return one.join(paths_by_track(links.where(F.col("track_id") == track), files), "track_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def set_override(tracks: DataFrame, links: DataFrame, files: DataFrame, track: str, field: str, value: str | None) -> Change:
    """A person's value of one field; a null counts as a value."""
    if field not in FIELDS:
        raise CommandError(f"{field!r} cannot be overridden")
    find(tracks, "track_id", track)
    payload = F.struct(F.col("track_id").alias("track_public_id"), F.lit(field).alias("field"), F.lit(value).cast("string").alias("value"), F.col("paths").alias("track_relative_paths"))
    return Change(_event(_paths_of(track, links, files), OVERRIDE, payload, "track_id"))


def activated(tracks: DataFrame, track: str, preferred: str | None = None) -> DataFrame:
    mine = F.col("track_id") == track
    best = F.col("preferred_file_id") if preferred is None else F.when(mine, F.lit(preferred)).otherwise(F.col("preferred_file_id"))
    return tracks.withColumns({"status": F.when(mine, "ACTIVE").otherwise(F.col("status")), "preferred_file_id": best})


def merge(tracks: DataFrame, links: DataFrame, files: DataFrame, gone: str, into: str) -> Change:
    """A person says that two tracks are one; all files of ``gone`` become files of ``into``."""
    if gone == into:
        raise CommandError("a track cannot be merged into itself")
    find(tracks, "track_id", gone, into)
    source, target = _paths_of(gone, links, files), _paths_of(into, links, files)
    both = source.select(F.lit(into).alias("track_id"), F.col("track_id").alias("gone"), F.col("paths").alias("source")).join(target.select("track_id", F.col("paths").alias("target")), "track_id")
    payload = merge_payload(F.transform("source", lambda _: F.lit("AUDIO_EQUIVALENT")), F.lit("HUMAN"))
    moved = (F.col("track_id") == gone) & F.col("is_active")
    new_links = links.withColumns({"relationship": F.when(moved, "AUDIO_EQUIVALENT").otherwise(F.col("relationship")), "decision_source": F.when(moved, "HUMAN").otherwise(F.col("decision_source")), "track_id": F.when(moved, F.lit(into)).otherwise(F.col("track_id"))})
    merged = F.col("track_id") == gone
    new_tracks = activated(tracks, into).withColumns({"status": F.when(merged, "MERGED").when(F.col("track_id") == into, "ACTIVE").otherwise(F.col("status")), "merged_into": F.when(merged, F.lit(into)).otherwise(F.col("merged_into"))})
    return Change(_event(both, MERGE, payload, "track_id"), new_links, new_tracks)


def merge_payload(relations: Column, source: Column) -> Column:
    """From columns track_id, gone, source and target (paths before the merge); ``relations``: of the paths in source."""
    return F.struct(
        F.col("gone").alias("source_track_public_id"), F.col("track_id").alias("target_track_public_id"), F.col("source").alias("source_file_relative_paths"),
        F.col("target").alias("target_file_relative_paths"), F.map_from_arrays("source", relations).alias("file_relationships"), source.alias("decision_source"),
    )


def split(tracks: DataFrame, links: DataFrame, files: DataFrame, groups: DataFrame, members: DataFrame, source: str, moved: list[str], new_track: str) -> Change:
    """A person says that some files of a track are another track, named ``new_track``; the first of ``moved`` gives its identity.

    Open groups that have files on both sides are rejected, so that no run merges them again.
    """
    if not moved:
        raise CommandError("a split moves nothing")
    find(tracks, "track_id", source)
    mine = find(files, "file_id", *moved)
    owned = links.where(F.col("is_active") & (F.col("track_id") == source) & F.col("file_id").isin(*moved)).count()
    if owned != len(set(moved)):
        raise CommandError(f"{source} does not own all of {', '.join(moved)}")
    taken = (F.col("track_id") == source) & F.col("is_active") & F.col("file_id").isin(*moved)
    new_links = links.withColumns({"relationship": F.when(taken, "PRIMARY").otherwise(F.col("relationship")), "decision_source": F.when(taken, "HUMAN").otherwise(F.col("decision_source")), "track_id": F.when(taken, F.lit(new_track)).otherwise(F.col("track_id"))})
    first = mine.where(F.col("file_id") == moved[0])
    created = first.select(F.lit(new_track).alias("track_id"), F.lit("ACTIVE").alias("status"), *(F.col(f"resolved_{f}").alias(f) for f in FIELDS), F.col("file_id").alias("preferred_file_id"), F.lit(None).cast("string").alias("merged_into"), "featured")
    kept = links.where(F.col("is_active") & (F.col("track_id") == source) & ~F.col("file_id").isin(*moved)).select("file_id")
    spanning = spanning_groups(members, mine.select("file_id"), kept).select("group_id", F.lit(True).alias("_spans"))
    hit = F.coalesce("_spans", F.lit(False)) & F.col("status").isin(*ANALYZABLE)
    new_groups = groups.join(spanning, "group_id", "left").withColumn("status", F.when(hit, "REJECTED").otherwise(F.col("status"))).drop("_spans")
    named = mine.agg(F.array_sort(F.collect_list("relative_path")).alias("moved")).select(F.lit(source).alias("track_id"), "moved")
    sides = _paths_of(source, new_links, files).join(named, "track_id")
    payload = F.struct(F.col("track_id").alias("source_track_public_id"), F.lit(new_track).alias("new_track_public_id"), F.col("moved").alias("moved_file_relative_paths"), F.col("paths").alias("remaining_file_relative_paths"))
    return Change(_event(sides.withColumn("new", F.lit(new_track)), SPLIT, payload, "new"), new_links, tracks.unionByName(created), new_groups)


def relationships(members: DataFrame, preferred: DataFrame, evidence: DataFrame) -> DataFrame:
    """group_id, file_id, relationship of each member to its group's preferred file.

    evidence: group_id, left_file_id, right_file_id, classification. Pairs are looked
    up in one order of their ids, so this is an equi-join. Without evidence a
    member is taken for equivalent.
    """
    pairs = evidence.select("group_id", F.least("left_file_id", "right_file_id").alias("lo"), F.greatest("left_file_id", "right_file_id").alias("hi"), (F.col("classification") == "EXACT").alias("exact"))
    pairs = pairs.groupBy("group_id", "lo", "hi").agg(F.bool_or("exact").alias("exact"))
    own = members.select("group_id", "file_id").join(preferred.select("group_id", "preferred_file_id"), "group_id")
    own = own.withColumns({"lo": F.least("file_id", "preferred_file_id"), "hi": F.greatest("file_id", "preferred_file_id")}).join(pairs, ["group_id", "lo", "hi"], "left")
    kind = F.when(F.col("file_id") == F.col("preferred_file_id"), "PRIMARY").when(F.col("exact"), "EXACT_DUPLICATE").otherwise("AUDIO_EQUIVALENT")
    return own.select("group_id", "file_id", "preferred_file_id", kind.alias("relationship"))


def consolidate(groups: DataFrame, members: DataFrame, evidence: DataFrame, tracks: DataFrame, links: DataFrame, files: DataFrame, source: str = "AUTOMATIC") -> tuple[Change, int]:
    """Folds each group (group_id, preferred_file_id) onto the track of its preferred file; also how many groups changed.

    Nothing happens to a group whose members are one track already, of which one has
    no track, or whose preferred file is no member. Of groups that share a track the
    one with the smallest id goes first and the others follow on its outcome, in
    rounds; groups that share nothing are done at once.
    """
    spark, done, events, active = groups.sparkSession, 0, None, links
    todo = groups.select("group_id", "preferred_file_id").where("preferred_file_id is not null")
    checkpoint_folder(spark)
    now_tracks = tracks
    while True:
        owner = active.where("is_active").select("file_id", "track_id")
        owned = members.join(todo, "group_id").join(owner, "file_id", "left")
        state = owned.groupBy("group_id").agg(F.count_distinct("track_id").alias("tracks"), F.count_if(F.col("track_id").isNull()).alias("homeless"), F.max(F.when(F.col("file_id") == F.col("preferred_file_id"), F.col("track_id"))).alias("survivor"))
        able = state.where("tracks > 1 and homeless = 0 and survivor is not null").select("group_id", "survivor")
        touched = owned.join(able, "group_id").select("group_id", "track_id", "survivor").distinct()
        first = touched.groupBy("track_id").agg(F.min("group_id").alias("first"))
        free = touched.join(first, "track_id").groupBy("group_id").agg(F.bool_and(F.col("group_id") == F.col("first")).alias("free")).where("free").select("group_id")
        batch = touched.join(free, "group_id").checkpoint()
        n = batch.select("group_id").distinct().count()
        if not n:
            break
        done += n
        best = todo.join(batch.select("group_id").distinct(), "group_id")
        relation = relationships(members.join(best.select("group_id"), "group_id", "left_semi"), best, evidence).select("file_id", "group_id", "relationship")
        gone = batch.where("track_id <> survivor")
        moved = active.where("is_active").join(gone.select("track_id", "survivor", "group_id"), "track_id").join(relation.select("file_id", "group_id", F.col("relationship").alias("_kind")), ["file_id", "group_id"], "left")
        moved = moved.select("file_id", F.col("survivor").alias("_into"), F.coalesce("_kind", F.lit("AUDIO_EQUIVALENT")).alias("_kind"), F.col("track_id").alias("gone")).checkpoint()
        new = _merge_events(moved, active, files, source)
        if source == "AUTOMATIC":
            chosen = best.join(batch.select("group_id", "survivor").distinct(), "group_id").join(files.select(F.col("file_id").alias("preferred_file_id"), "relative_path"), "preferred_file_id")
            new = new.unionByName(_event(chosen, AUTO_PREFERRED, F.struct(F.col("relative_path").alias("preferred_file_relative_path")), "survivor", "preferred_file_id"))
        new = new.checkpoint()
        events = new if events is None else events.unionByName(new)
        step = moved.select("file_id", "_into", "_kind")
        active = active.join(step, "file_id", "left")
        hit = F.col("_into").isNotNull() & F.col("is_active")
        active = active.withColumns({"track_id": F.when(hit, F.col("_into")).otherwise(F.col("track_id")), "relationship": F.when(hit, F.col("_kind")).otherwise(F.col("relationship")), "decision_source": F.when(hit, F.lit(source)).otherwise(F.col("decision_source"))}).drop("_into", "_kind").checkpoint()
        ends = gone.select("track_id", F.col("survivor").alias("_into"), F.lit(None).cast("string").alias("_best")).unionByName(best.join(batch.select("group_id", "survivor").distinct(), "group_id").select(F.col("survivor").alias("track_id"), F.lit(None).cast("string").alias("_into"), F.col("preferred_file_id").cast("string").alias("_best")))
        now_tracks = now_tracks.join(ends, "track_id", "left")
        now_tracks = now_tracks.withColumns({"status": F.when(F.col("_into").isNotNull(), "MERGED").when(F.col("_best").isNotNull(), "ACTIVE").otherwise(F.col("status")), "merged_into": F.coalesce("_into", "merged_into"), "preferred_file_id": F.coalesce("_best", "preferred_file_id")}).drop("_into", "_best").checkpoint()
        todo = todo.join(batch.select("group_id").distinct(), "group_id", "left_anti")
    empty = spark.createDataFrame([], EVENT)
    return Change(empty if events is None else events, active, now_tracks), done


def _merge_events(moved: DataFrame, active: DataFrame, files: DataFrame, source: str) -> DataFrame:
    """One event for each absorbed track, with the paths of both sides as they were just before it."""
    paths = paths_by_track(active, files)
    kinds = moved.join(files.select("file_id", "relative_path"), "file_id")
    parts = kinds.groupBy(F.col("_into").alias("track_id"), "gone").agg(F.array_sort(F.collect_list(F.struct("relative_path", "_kind"))).alias("moves"))
    parts = parts.withColumns({"source": F.transform("moves", lambda m: m["relative_path"]), "kinds": F.transform("moves", lambda m: m["_kind"])})
    before = Window.partitionBy("track_id").orderBy("gone").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.flatten(F.collect_list("source").over(before))).join(paths, "track_id", "left")
    parts = parts.withColumn("target", F.array_sort(F.concat(F.coalesce("paths", F.array().cast("array<string>")), "earlier")))
    return _event(parts, MERGE, merge_payload(F.col("kinds"), F.lit(source)), "track_id")


def import_decisions(decisions: DataFrame, groups: DataFrame, members: DataFrame, links: DataFrame, files: DataFrame, report: str) -> tuple[DataFrame, DataFrame]:
    """Events of a checked file's decisions, and the groups after them; all of them or none.

    decisions: group_id, decision, preferred_file_id. groups: group_id, status, proposed_preferred_file_id.
    """
    linked = files.select("file_id", "relative_path").join(links.where("is_active").select("file_id", F.lit(True).alias("linked")), "file_id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    judged = first_failures(decisions, groups, members, linked)
    failed = judged.where("failure is not null").select("group_id", "failure").limit(20).collect()
    if failed:
        raise CommandError("; ".join(f"{r.group_id}: {r.failure}" for r in failed))
    kind = F.lit(None).cast("string")
    for decision, event in EVENTS.items():
        kind = F.when(F.col("decision") == decision, event).otherwise(kind)
    chosen = decisions.join(groups.select("group_id", "proposed_preferred_file_id"), "group_id")
    best = F.when(F.col("decision") == "CHANGE_PREFERRED", F.col("preferred_file_id")).when(F.col("decision") == "CONFIRM", F.col("proposed_preferred_file_id"))
    chosen = chosen.withColumn("_best", best).join(files.select(F.col("file_id").alias("_best"), F.col("relative_path").alias("best_path")), "_best", "left")
    paths = members.join(files.select("file_id", "relative_path"), "file_id").groupBy("group_id").agg(F.array_sort(F.collect_list("relative_path")).alias("paths"))
    chosen = chosen.join(paths, "group_id").withColumn("_event", kind)
    payload = F.struct("group_id", "decision", F.lit(report).alias("report_id"), F.col("_best").alias("preferred_file_id"), F.col("best_path").alias("preferred_file_relative_path"), F.col("paths").alias("member_file_relative_paths"))
    events = chosen.select(F.col("_event").alias("event_type"), F.lit(None).cast("string").alias("track_id"), F.col("_best").cast("string").alias("file_id"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))
    status = F.when(F.col("decision").isin("CONFIRM", "CHANGE_PREFERRED"), "CONFIRMED").when(F.col("decision") == "REJECT", "REJECTED").when(F.col("decision") == "DEFER", "DEFERRED")
    after = groups.join(decisions.select("group_id", "decision"), "group_id", "left").withColumn("status", F.coalesce(status, "status")).drop("decision")
    return events, after


def track_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct track_id, group_id of the groups that a track's active files are in."""
    return links.where("is_active").select("file_id", "track_id").join(members.select("file_id", "group_id"), "file_id").select("track_id", "group_id").distinct()
