"""Commands over a stored catalogue: ``python -m kindred.cli --root FOLDER COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.evidence import CLASSES
from kindred.operators import commands, decisions, journal, reports
from kindred.operators.replay import OVERRIDE
from kindred.sources import review
from kindred.sources.store import Store


def overrides(store: Store) -> DataFrame:
    """seq, track, field, value of the stored events."""
    e = store.read("events").where(F.col("event_type") == OVERRIDE)
    of = lambda name: F.get_json_object("payload", f"$.{name}")
    return e.select(F.col("sequence").alias("seq"), F.col("track_id").alias("track"), of("field").alias("field"), of("value").alias("value"))


def identity(store: Store) -> DataFrame:
    """track_id, track_status and the effective identity of all tracks."""
    tracks = store.read("tracks").withColumnRenamed("track_id", "track")
    out = journal.effective_identity(tracks, overrides(store)) if "events" in store.tables() else tracks
    return out.select(F.col("track").alias("track_id"), F.col("status").alias("track_status"), *journal.FIELDS, "featured")


def catalog(store: Store) -> DataFrame:
    ident = identity(store)
    featured = ident.select("track_id", F.inline("featured")).drop("source")
    quality = store.read("quality") if "quality" in store.tables() else store.spark.createDataFrame([], "id long, file_id string, quality_score double")
    return reports.catalog_export(store.read("files"), store.read("links"), ident.drop("featured"), featured, quality)


def stats(store: Store) -> DataFrame:
    """category, metric, value of all that the store has."""
    have = store.tables()
    out = reports.file_stats(store.read("files")).unionByName(reports.counts_by(store.read("tracks"), "tracks", "status", reports.TRACK_STATUSES))
    if "scans" in have:
        out = out.unionByName(reports.scan_stats(store.read("scans").withColumn("id", F.col("public_id"))))
    if "groups" in have:
        out = out.unionByName(reports.counts_by(store.read("groups"), "groups", "status", reports.GROUP_STATUSES))
    if "pairs" in have:
        out = out.unionByName(reports.pair_stats(store.read("pairs"), CLASSES))
    return out


def append_events(store: Store, events: DataFrame, **tables: DataFrame) -> None:
    """Numbers a command's events behind those of the store and commits them with the tables it changed."""
    top = store.read("events").agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0] if "events" in store.tables() else 0
    now = datetime.now(UTC).replace(tzinfo=None)
    rows = events.withColumns({"recorded_at": F.lit(now), "event_uuid": F.sha2(F.concat_ws("|", "event_type", "payload", F.lit(uuid.uuid4().hex)), 256)})
    store.commit(append={"events": reports.numbered(rows, top)}, **tables)


def apply(store: Store, change: commands.Change) -> None:
    tables = {n: t for n, t in (("links", change.links), ("tracks", change.tracks), ("groups", change.groups)) if t is not None}
    append_events(store, change.events, **tables)


def inspect(store: Store, public_id: str) -> dict:
    """What is known of a file, track or group."""
    if public_id.startswith("fil_"):
        row = commands.find(catalog(store), "file_public_id", public_id).first()
        return {"file": row.asDict()}
    if public_id.startswith("trk_"):
        out = {"track": commands.find(identity(store), "track_id", public_id).drop("featured").first().asDict()}
        links = store.read("links").where(F.col("track_id") == public_id)
        out["files"] = [r.asDict() for r in links.join(store.read("files").select("file_id", "relative_path"), "file_id").orderBy("relative_path").collect()]
        if "members" in store.tables():
            out["groups"] = sorted(r.group_id for r in commands.track_groups(links, store.read("members")).collect())
        return out
    group = commands.find(store.read("groups"), "group_id", public_id).first().asDict()
    return {"group": group, "members": sorted(r.file_id for r in store.read("members").where(F.col("group_id") == public_id).collect())}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kindred")
    parser.add_argument("--root", required=True)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("stats")
    sub.add_parser("runs").add_argument("run_id", nargs="?")
    sub.add_parser("inspect").add_argument("public_id")
    e = sub.add_parser("export")
    e.add_argument("--format", choices=("csv", "json"), default="csv")
    e.add_argument("--output")
    o = sub.add_parser("override")
    o.add_argument("track")
    o.add_argument("field", choices=commands.FIELDS)
    o.add_argument("value", nargs="?")
    m = sub.add_parser("merge")
    m.add_argument("source")
    m.add_argument("target")
    s = sub.add_parser("split")
    s.add_argument("source")
    s.add_argument("files", nargs="+")
    sub.add_parser("import-decisions").add_argument("path")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    store, out = Store(spark, args.root), sys.stdout
    read = store.read
    try:
        if args.command == "stats":
            for r in stats(store).orderBy("category", "metric").collect():
                out.write(f"{r.category}.{r.metric}: {r.value}\n")
        elif args.command == "runs":
            rows = read("runs")
            rows = commands.find(rows, "public_id", args.run_id) if args.run_id else rows.orderBy(F.desc("started_at")).limit(20)
            for r in rows.collect():
                out.write(json.dumps(r.asDict(), default=str) + "\n")
        elif args.command == "inspect":
            out.write(json.dumps(inspect(store, args.public_id), default=str, indent=2) + "\n")
        elif args.command == "export":
            path = args.output or str(review.default_export_path(Path(args.root), "catalog", args.format, datetime.now(UTC)))
            review.export(catalog(store), args.format, path, ["relative_path"])
            out.write(path + "\n")
        elif args.command == "override":
            apply(store, commands.set_override(read("tracks"), read("links"), read("files"), args.track, args.field, args.value))
        elif args.command == "merge":
            apply(store, commands.merge(read("tracks"), read("links"), read("files"), args.source, args.target))
        elif args.command == "split":
            new = "trk_" + uuid.uuid4().hex
            apply(store, commands.split(read("tracks"), read("links"), read("files"), read("groups"), read("members"), args.source, args.files, new))
            out.write(new + "\n")
        else:
            data = json.loads(Path(args.path).read_text(encoding="utf-8"))
            rows = spark.createDataFrame([(d["group_id"], d["decision"], d.get("preferred_file_id")) for d in decisions.check_file(data)], "group_id string, decision string, preferred_file_id string")
            events, groups = commands.import_decisions(rows, read("groups"), read("members"), read("links"), read("files"), data["report_id"])
            append_events(store, events, groups=groups)
    except (commands.CommandError, decisions.DecisionError, KeyError) as error:
        sys.stderr.write(f"{error}\n")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
