"""Replay of an ordered journal onto freshly scanned records.

What a person decided is folded in order, since merges, splits and decisions
change what later events mean. An event changes only the tracks of the paths that
it names, and a track that it splits off. Tracks that no chain of events connects
do not touch each other, so each set of connected tracks is folded by itself, in
one task: its events one after the other, with the state of that set in memory.
Only records named by an event, with all others of their tracks, take part; the
catalogue stays distributed and gets the outcome by a join.

An event that names an unknown path, or paths of several tracks where one is
meant, stops the replay: nothing is returned.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from kindred.operators import groups as G

GROUP_EVENTS = {"DUPLICATE_GROUP_CONFIRMED", "DUPLICATE_GROUP_PREFERRED_CHANGED", "DUPLICATE_GROUP_REJECTED", "DUPLICATE_GROUP_DEFERRED"}
OVERRIDE, MERGE, SPLIT, AUTO_PREFERRED = "TRACK_OVERRIDE_SET", "TRACK_MERGE", "TRACK_SPLIT", "TRACK_PREFERRED_FILE_AUTO_SET"


class ReplayError(ValueError):
    """An event cannot be applied without guessing."""


@dataclass
class Track:
    name: str
    status: str = "PROVISIONAL"
    merged_into: str | None = None
    preferred: str | None = None
    overrides: dict[str, str | None] = field(default_factory=dict)


@dataclass
class Link:
    track: str
    relationship: str = "PRIMARY"
    source: str = "AUTOMATIC"


class State:
    """Tracks by the id that the scan gave them, links by path, groups by their set of paths.

    Groups come from decisions alone and so are resolved; a split changes open groups only.
    """

    def __init__(self, owners: dict[str, str]):
        self.links = {path: Link(track) for path, track in owners.items()}
        self.tracks = {t: Track(t) for t in owners.values()}
        self.groups: dict[frozenset[str], tuple[str, str]] = {}

    def link(self, path: str) -> Link:
        if path not in self.links:
            raise ReplayError(f"no record at {path!r}")
        return self.links[path]

    def owner(self, paths: list[str]) -> str:
        found = {self.link(p).track for p in paths}
        if len(found) != 1:
            raise ReplayError(f"{len(found)} tracks for {sorted(paths)}, not one")
        return found.pop()

    def paths_of(self, track: str) -> list[str]:
        return [p for p, link in self.links.items() if link.track == track]

    def merge(self, into: str, gone: str, relations: dict[str, str], source: str) -> None:
        for path in self.paths_of(gone):
            self.links[path] = Link(into, relations.get(path, "AUDIO_EQUIVALENT"), source)
        self.tracks[gone].status, self.tracks[gone].merged_into = "MERGED", into
        self.tracks[into].status = "ACTIVE"

    def activate(self, track: str, preferred: str) -> None:
        self.tracks[track].status, self.tracks[track].preferred = "ACTIVE", preferred

    # One method for each kind of event ----------------------------------------

    def on_override(self, p: dict) -> None:
        track = self.tracks[self.owner(p.get("track_relative_paths") or [])]
        track.name = p["track_public_id"]
        track.overrides[p["field"]] = p["value"]

    def on_merge(self, p: dict) -> None:
        into, gone = self.owner(p["target_file_relative_paths"]), self.owner(p["source_file_relative_paths"])
        if into == gone:
            return
        relations = p.get("file_relationships") or {}
        for path in relations:
            self.link(path)
        self.merge(into, gone, relations, p["decision_source"])
        self.tracks[into].name, self.tracks[gone].name = p["target_track_public_id"], p["source_track_public_id"]

    def on_split(self, p: dict) -> None:
        moved = p["moved_file_relative_paths"]
        if not moved:
            raise ReplayError("a split moves nothing")
        old, new = self.owner([*moved, *p["remaining_file_relative_paths"]]), "split:" + p["new_track_public_id"]
        self.tracks[new] = Track(p["new_track_public_id"])
        for path in moved:
            self.links[path] = Link(new, "PRIMARY", "HUMAN")
        self.activate(new, moved[0])
        self.tracks[old].name = p["source_track_public_id"]

    def on_auto_preferred(self, p: dict) -> None:
        path = p["preferred_file_relative_path"]
        self.activate(self.link(path).track, path)

    def on_group(self, p: dict) -> None:
        members = frozenset(p.get("member_file_relative_paths") or [])
        if not members:
            raise ReplayError("a decision names no members")
        for path in members:
            self.link(path)
        action = p["decision"]
        if action in ("CONFIRM", "CHANGE_PREFERRED"):
            best = p.get("preferred_file_relative_path")
            if not best:
                raise ReplayError(f"{action} names no preferred record")
            into = self.link(best).track
            if best in members:
                for gone in dict.fromkeys(self.links[m].track for m in sorted(members)):
                    if gone != into:
                        self.merge(into, gone, {}, "HUMAN")
            self.activate(into, best)
            status = "CONFIRMED"
        elif action in ("REJECT", "DEFER"):
            status = "REJECTED" if action == "REJECT" else "DEFERRED"
        else:
            raise ReplayError(f"unknown decision {action!r}")
        self.groups[members] = (p["group_id"], status)

    def apply(self, kind: str, payload: dict) -> None:
        if kind in GROUP_EVENTS:
            return self.on_group(payload)
        steps = {OVERRIDE: self.on_override, MERGE: self.on_merge, SPLIT: self.on_split, AUTO_PREFERRED: self.on_auto_preferred}
        if kind not in steps:
            raise ReplayError(f"unknown kind of event {kind!r}")
        return steps[kind](payload)


def fold(owners: dict[str, str], events: Iterable[Row | dict]) -> State:
    """Events, in order, need sequence, event_type and payload (JSON). A repeated sequence is one event; see the journal's append."""
    state, last = State(owners), None
    for e in events:
        if e["sequence"] == last:
            continue
        last = e["sequence"]
        try:
            state.apply(e["event_type"], json.loads(e["payload"]))
        except (ReplayError, KeyError, TypeError, AttributeError, ValueError) as error:
            raise ReplayError(f"event {last} ({e['event_type']}): {error}") from error
    return state


PATH_FIELDS = ("track_relative_paths", "target_file_relative_paths", "source_file_relative_paths", "moved_file_relative_paths", "remaining_file_relative_paths", "member_file_relative_paths")


def _paths():
    """All paths that an event names."""
    lists = [F.coalesce(F.from_json(F.get_json_object("payload", f"$.{f}"), "array<string>"), F.array().cast("array<string>")) for f in PATH_FIELDS]
    one = F.array_compact(F.array(F.get_json_object("payload", "$.preferred_file_relative_path")))
    keys = F.coalesce(F.map_keys(F.from_json(F.get_json_object("payload", "$.file_relationships"), "map<string,string>")), F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(*lists, one, keys)))


#: Rows of a set of connected tracks, in the order in which they are folded: links, then events.
FOLDED = "kind int, a string, b string, c string, d string, members array<string>"


def _fold_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by set; within it links (sequence null) and then events in order. Outcomes: kind 0 links, 1 tracks, 2 overrides, 3 groups."""

    def rows() -> Iterator[tuple]:
        for frame in frames:
            yield from zip(*(frame[c].tolist() for c in ("part", "is_event", "sequence", "x", "y")), strict=True)

    out: list[tuple] = []
    names = ["kind", "a", "b", "c", "d", "members"]
    stream = rows()
    row = next(stream, None)
    while row is not None:
        part, owners = row[0], {}
        while row is not None and row[0] == part and not row[1]:
            owners[row[3]] = row[4]
            row = next(stream, None)

        def events() -> Iterator[dict]:
            nonlocal row
            while row is not None and row[0] == part:
                yield {"sequence": int(row[2]), "event_type": row[3], "payload": row[4]}
                row = next(stream, None)

        state = fold(owners, events())
        name = lambda t: state.tracks[t].name if t else None  # noqa: B023, E731
        out += [(0, p, name(x.track), x.relationship, x.source, None) for p, x in state.links.items()]
        out += [(1, i, t.name, t.status, name(t.merged_into), [t.preferred] if t.preferred is not None else None) for i, t in state.tracks.items()]
        out += [(2, t.name, f, None if v is None else str(v), None, None) for t in state.tracks.values() for f, v in t.overrides.items()]
        out += [(3, g, status, None, None, sorted(m)) for m, (g, status) in state.groups.items()]
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=names)
            out = []
    yield pd.DataFrame(out, columns=names)


@dataclass
class Outcome:
    links: DataFrame
    tracks: DataFrame
    overrides: DataFrame
    groups: DataFrame
    counts: DataFrame


def _sets(links: DataFrame, events: DataFrame) -> DataFrame:
    """part, is_event, sequence, x, y: links (path, track) of the tracks that events name, and events (type, payload), by set of connected tracks.

    Events that name no track that is known make a set of their own each.
    """
    named = events.select("sequence", F.explode(_paths()).alias("relative_path")).join(links, "relative_path").select("sequence", "track_id")
    new = F.get_json_object("payload", "$.new_track_public_id")
    split = events.where((F.col("event_type") == SPLIT) & new.isNotNull()).select("sequence", F.concat(F.lit("split:"), new).alias("track_id"))
    touched = named.unionByName(split).distinct()
    first = touched.groupBy("sequence").agg(F.min("track_id").alias("left_id"))
    pairs = touched.join(first, "sequence").select("left_id", F.col("track_id").alias("right_id")).distinct()
    parts = G.connected_components(pairs).select(F.col("file_id").alias("track_id"), F.col("group_id").alias("part"))
    of = first.withColumnRenamed("left_id", "track_id").join(parts, "track_id").select("sequence", F.concat(F.lit("t"), "part").alias("part"))
    steps = events.join(of, "sequence", "left").select(F.coalesce("part", F.concat(F.lit("e"), F.col("sequence").cast("string"))).alias("part"), F.lit(True).alias("is_event"), F.col("sequence").cast("long").alias("sequence"), F.col("event_type").alias("x"), F.col("payload").alias("y"))
    own = links.join(parts, "track_id").select(F.concat(F.lit("t"), "part").alias("part"), F.lit(False).alias("is_event"), F.lit(-1).cast("long").alias("sequence"), F.col("relative_path").alias("x"), F.col("track_id").alias("y"))
    return own.unionByName(steps)


def _cause(error: Exception) -> ReplayError | None:
    """The replay's own error in what Spark says of a failed task."""
    at = [x for x in str(error).splitlines() if "ReplayError: " in x]
    return ReplayError(at[0].split("ReplayError: ", 1)[1]) if at else None


def replay(links: DataFrame, events: DataFrame, max_events: int | None = None) -> Outcome:
    """``links``: relative_path, track_id of the scan. The whole catalogue after all events; any number of them unless ``max_events`` is given."""
    events = events.select("sequence", "event_type", "payload")
    if max_events is not None and events.limit(max_events + 1).count() > max_events:
        raise ReplayError(f"more than {max_events} events")
    G.checkpoint_folder(links.sparkSession)
    links = links.select("relative_path", "track_id")
    ordered = _sets(links, events).repartition("part").sortWithinPartitions("part", "is_event", "sequence")
    try:
        out = ordered.mapInPandas(_fold_sets, FOLDED).checkpoint()
    except Exception as error:
        if (cause := _cause(error)) is None:
            raise
        raise cause from error
    moved = out.where("kind = 0").select(F.col("a").alias("relative_path"), F.col("b").alias("new_track"), F.col("c").alias("relationship"), F.col("d").alias("decision_source"))
    all_links = links.join(moved, "relative_path", "left").select("relative_path", F.coalesce("new_track", "track_id").alias("track_id"), F.coalesce("relationship", F.lit("PRIMARY")).alias("relationship"), F.coalesce("decision_source", F.lit("AUTOMATIC")).alias("decision_source"))
    changed = out.where("kind = 1").select(F.col("a").alias("scan_id"), F.col("b").alias("track_id"), F.col("c").alias("status"), F.col("d").alias("merged_into"), F.get("members", 0).alias("preferred_path"))
    rest = links.select("track_id").distinct().join(changed.select(F.col("scan_id").alias("track_id")), "track_id", "left_anti")
    nothing = F.lit(None).cast("string")
    all_tracks = changed.drop("scan_id").unionByName(rest.select("track_id", F.lit("PROVISIONAL").alias("status"), nothing.alias("merged_into"), nothing.alias("preferred_path")))
    overrides = out.where("kind = 2").select(F.col("a").alias("track_id"), F.col("b").alias("field"), F.col("c").alias("value"))
    groups = out.where("kind = 3").select(F.col("a").alias("group_id"), F.col("b").alias("status"), "members")
    counts = events.dropDuplicates(["sequence"]).groupBy("event_type").agg(F.count("*").alias("n"))
    return Outcome(all_links, all_tracks, overrides, groups, counts)
