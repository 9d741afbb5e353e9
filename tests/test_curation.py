"""Store, commands and replay end to end, analysis runs, exports and the command line."""

import base64
import json
import logging
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kindred import cli, logs
from kindred.functions import fingerprint, quality
from kindred.operators import analysis, commands, ingest, replay, reports
from kindred.sources import adapters, review
from kindred.sources.store import Store

FILES = "file_id string, relative_path string, resolved_artist string, resolved_title string, resolved_version string, resolved_edition string, featured array<struct<position:int,name:string,source:string>>"
TRACKS = "track_id string, status string, artist string, title string, version string, edition string, preferred_file_id string, merged_into string, featured array<struct<position:int,name:string,source:string>>"
LINKS = "file_id string, track_id string, relationship string, decision_source string, is_active boolean"
GROUPS = "group_id string, status string, confidence double, matcher_version string, proposed_preferred_file_id string"


@pytest.fixture
def tables(spark):
    n = "abcdef"
    files = spark.createDataFrame([(f"fil_{x}", f"p/{x}", f"artist {x}", f"title {x}", None, None, []) for x in n], FILES)
    tracks = spark.createDataFrame([(f"trk_{x}", "PROVISIONAL", f"artist {x}", f"title {x}", None, None, None, None, []) for x in n], TRACKS)
    links = spark.createDataFrame([(f"fil_{x}", f"trk_{x}", "PRIMARY", "AUTOMATIC", True) for x in n], LINKS)
    groups = spark.createDataFrame([("dup_1", "REVIEW_REQUIRED", 0.9, "1", "fil_b"), ("dup_2", "CONFIRMED", 1.0, "1", None), ("dup_3", "DETECTED", None, "1", None)], GROUPS)
    members = spark.createDataFrame([("dup_1", "fil_a"), ("dup_1", "fil_b"), ("dup_2", "fil_a"), ("dup_2", "fil_b"), ("dup_3", "fil_e"), ("dup_3", "fil_f")], "group_id string, file_id string")
    return {"files": files, "tracks": tracks, "links": links, "groups": groups, "members": members}


def owners(links):
    return {r.file_id: (r.track_id, r.relationship, r.decision_source) for r in links.where("is_active").collect()}


def test_override_merge_split_and_replay(spark, tables, tmp_path):
    """What the commands leave is what a replay of their events makes of a fresh scan."""
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit(**tables)
    read = store.read
    cli.apply(store, commands.set_override(read("tracks"), read("links"), read("files"), "trk_a", "title", None))
    cli.apply(store, commands.merge(read("tracks"), read("links"), read("files"), "trk_b", "trk_a"))
    cli.apply(store, commands.merge(read("tracks"), read("links"), read("files"), "trk_c", "trk_a"))
    cli.apply(store, commands.split(read("tracks"), read("links"), read("files"), read("groups"), read("members"), "trk_a", ["fil_b"], "trk_new"))
    want = {"fil_a": ("trk_a", "PRIMARY", "AUTOMATIC"), "fil_b": ("trk_new", "PRIMARY", "HUMAN"), "fil_c": ("trk_a", "AUDIO_EQUIVALENT", "HUMAN")}
    got = owners(read("links"))
    assert {k: got[k] for k in want} == want
    status = {r.track_id: (r.status, r.merged_into, r.preferred_file_id) for r in read("tracks").collect()}
    assert status["trk_a"] == ("ACTIVE", None, None) and status["trk_b"] == ("MERGED", "trk_a", None) and status["trk_new"] == ("ACTIVE", None, "fil_b")
    assert {r.group_id: r.status for r in read("groups").collect()} == {"dup_1": "REJECTED", "dup_2": "CONFIRMED", "dup_3": "DETECTED"}
    assert [(r.sequence, r.event_type) for r in read("events").orderBy("sequence").collect()] == [(1, "TRACK_OVERRIDE_SET"), (2, "TRACK_MERGE"), (3, "TRACK_MERGE"), (4, "TRACK_SPLIT")]
    identity = {r.track_id: (r.artist, r.title) for r in cli.identity(store).collect()}
    assert identity["trk_a"] == ("artist a", None) and identity["trk_new"] == ("artist b", "title b")
    fresh = tables["links"].join(tables["files"], "file_id").select("relative_path", F.concat(F.lit("scan "), "track_id").alias("track_id"))
    out = replay.replay(fresh, read("events"))
    again = {r.relative_path: (r.track_id, r.relationship, r.decision_source) for r in out.links.collect()}
    assert {f"p/{k[-1]}": v for k, v in want.items()} == {k: again[k] for k in ("p/a", "p/b", "p/c")}
    assert len(store.versions()) == 5 and store.read("links", 1).count() == 6
    store.expire(2)
    assert store.versions() == [4, 5] and read("links").count() == 6


def test_commands_refuse(tables):
    t, li, f, g, m = (tables[n] for n in ("tracks", "links", "files", "groups", "members"))
    for call in (
        lambda: commands.merge(t, li, f, "trk_a", "trk_a"),
        lambda: commands.merge(t, li, f, "trk_a", "trk_zz"),
        lambda: commands.set_override(t, li, f, "trk_a", "genre", "x"),
        lambda: commands.split(t, li, f, g, m, "trk_a", [], "trk_n"),
        lambda: commands.split(t, li, f, g, m, "trk_a", ["fil_b"], "trk_n"),
        lambda: commands.split(t, li, f, g, m, "trk_a", ["fil_zz"], "trk_n"),
    ):
        with pytest.raises(commands.CommandError):
            call()


def test_consolidation_of_overlapping_groups(spark, tables):
    """Groups that share a track follow on each other's outcome; one without a preferred member does nothing."""
    members = spark.createDataFrame([("g1", "fil_a"), ("g1", "fil_b"), ("g2", "fil_b"), ("g2", "fil_c"), ("g3", "fil_d"), ("g3", "fil_e"), ("g4", "fil_e"), ("g4", "fil_f")], "group_id string, file_id string")
    best = spark.createDataFrame([("g1", "fil_a"), ("g2", "fil_c"), ("g3", "fil_d"), ("g4", "fil_a"), ("g5", None)], "group_id string, preferred_file_id string")
    evidence = spark.createDataFrame([("g1", "fil_b", "fil_a", "EXACT"), ("g3", "fil_d", "fil_e", "PROBABLE")], "group_id string, left_file_id string, right_file_id string, classification string")
    change, n = commands.consolidate(best, members, evidence, tables["tracks"], tables["links"], tables["files"])
    assert n == 3
    got = {k: v[:2] for k, v in owners(change.links).items()}
    assert got == {"fil_a": ("trk_c", "AUDIO_EQUIVALENT"), "fil_b": ("trk_c", "AUDIO_EQUIVALENT"), "fil_c": ("trk_c", "PRIMARY"), "fil_d": ("trk_d", "PRIMARY"), "fil_e": ("trk_d", "AUDIO_EQUIVALENT"), "fil_f": ("trk_f", "PRIMARY")}
    status = {r.track_id: (r.status, r.merged_into, r.preferred_file_id) for r in change.tracks.collect()}
    assert status["trk_c"] == ("ACTIVE", None, "fil_c") and status["trk_a"] == ("MERGED", "trk_c", "fil_a") and status["trk_b"] == ("MERGED", "trk_a", None) and status["trk_f"] == ("PROVISIONAL", None, None)
    merges = sorted((json.loads(r.payload)["source_file_relative_paths"], json.loads(r.payload)["target_file_relative_paths"]) for r in change.events.where("event_type = 'TRACK_MERGE'").collect())
    assert merges == [(["p/a", "p/b"], ["p/c"]), (["p/b"], ["p/a"]), (["p/e"], ["p/d"])]


def test_decisions_become_events_or_nothing(spark, tables):
    rows = lambda *x: spark.createDataFrame(list(x), "group_id string, decision string, preferred_file_id string")
    events, after = commands.import_decisions(rows(("dup_1", "CONFIRM", None)), tables["groups"], tables["members"], tables["links"], tables["files"], "rpt_1")
    e = events.first()
    assert e.event_type == "DUPLICATE_GROUP_CONFIRMED" and json.loads(e.payload)["preferred_file_relative_path"] == "p/b"
    assert {r.group_id: r.status for r in after.collect()}["dup_1"] == "CONFIRMED"
    with pytest.raises(commands.CommandError, match="ALREADY_RESOLVED"):
        commands.import_decisions(rows(("dup_1", "CONFIRM", None), ("dup_2", "REJECT", None)), tables["groups"], tables["members"], tables["links"], tables["files"], "rpt_1")


def test_analysis_run(spark):
    records = spark.createDataFrame([(f"fil_{i}", f"p/{i}", "x", "song" if i < 3 else f"title number {i}", None, 200_000, i != 2) for i in range(6)], "file_id string, relative_path string, artist string, title string, version string, duration_ms long, is_present boolean")
    records = records.withColumns({"tol": F.lit(2000).cast("long"), "wtol": F.lit(1000).cast("long")})
    tracks = records.select(F.concat(F.lit("trk_"), "file_id").alias("track_id"), F.lit("PROVISIONAL").alias("status"), F.lit(None).cast("string").alias("preferred_file_id"), F.lit(None).cast("string").alias("merged_into"))
    links = records.select("file_id", F.concat(F.lit("trk_"), "file_id").alias("track_id"), F.lit("PRIMARY").alias("relationship"), F.lit("AUTOMATIC").alias("decision_source"), F.lit(True).alias("is_active"))
    known = spark.createDataFrame([], GROUPS)
    members = spark.createDataFrame([], "group_id string, file_id string")
    evidence = lambda p: p.withColumns({"same_bytes": (F.col("left_id") == "fil_0") & (F.col("right_id") == "fil_1"), "version_state": F.lit("COMPATIBLE"), "sound": F.lit(0.95)})
    merit = spark.createDataFrame([(f"fil_{i}", True, "NONE", float(i), True, False, 1.0) for i in range(6)], "file_id string, intact boolean, suspicion string, score double, lossless boolean, clipped boolean, complete double")
    run = analysis.run(records, known, members, tracks, links, evidence, merit)
    found = {tuple(sorted(x.file_id for x in run.members.where(F.col("group_id") == r.group_id).collect())): (r.status, r.proposed_preferred_file_id) for r in run.groups.collect()}
    assert found == {("fil_0", "fil_1"): ("AUTO_CONFIRMED", "fil_1"), ("fil_3", "fil_4", "fil_5"): ("REVIEW_REQUIRED", "fil_5")}
    assert (run.detected, run.analyzed, run.consolidated) == (2, 2, 1)
    again = analysis.run(records, run.groups, run.members, run.change.tracks, run.change.links, evidence, merit)
    assert again.groups.count() == 2 and (again.detected, again.consolidated) == (2, 0)


def test_reasons_of_the_preferred_file(spark):
    one = "struct<file_id:string,intact:boolean,suspicion:string,score:double,lossless:boolean,clipped:boolean,complete:double,historical:double>"
    rows = [(1, [("a", True, "NONE", 80.0, False, False, 0.5, None), ("b", True, "HIGH", 99.0, True, False, 1.0, 9.0), ("c", True, "NONE", 80.0, False, False, 0.9, None), ("d", True, "NONE", 80.0, False, False, 0.9, 1.0)]), (2, [("z", True, "NONE", 1.0, True, False, 0.0, None)]), (3, [])]
    got = {r.k: r.c for r in spark.createDataFrame(rows, f"k int, v array<{one}>").select("k", quality.choose(F.col("v")).alias("c")).collect()}
    assert got[1].file_id == "c" and got[1].reasons == [quality.REASONS[1], quality.REASONS[5], quality.TIED]
    assert got[2].reasons == [quality.ALONE] and got[3] is None


def pack(numbers):
    """A compressed fingerprint, by the published format."""
    steps, more = [], []
    for i, n in enumerate(numbers):
        x, last = n ^ (numbers[i - 1] if i else 0), 0
        for place in range(1, 33):
            if x >> (place - 1) & 1:
                gap, last = place - last, place
                steps.append(min(gap, 7))
                if gap >= 7:
                    more.append(gap - 7)
        steps.append(0)

    def bits(values, width):
        total = sum(v << (width * i) for i, v in enumerate(values))
        return total.to_bytes(-(-width * len(values) // 8), "little")

    data = bytes([1]) + len(numbers).to_bytes(3, "big") + bits(steps, 3) + bits(more, 5)
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def test_fingerprint_text(spark):
    numbers = [0x1, 0x80000001, 0xFFFFFFFF, 0, 0x00010000, 0x12345678, 0x12345679]
    assert [x & 0xFFFFFFFF for x in fingerprint.decode_text(pack(numbers))] == numbers
    rows = [(pack(numbers), pack(numbers)), (pack(numbers), "AQ"), (pack(numbers), None), (pack(numbers), pack([~x & 0xFFFFFFFF for x in numbers]))]
    got = [r.s for r in fingerprint.with_similarity(spark.createDataFrame(rows, "a string, b string"), "a", "b", "s").collect()]
    assert got[:3] == [1.0, 0.0, 0.0] and got[3] < 0.5


def test_shift_window(spark):
    """Shifts go from -120 to 119."""
    base = [(i * 2654435761) % (1 << 31) for i in range(300)]
    rows = [(k, base[max(0, -k) : max(0, -k) + 100], base[max(0, k) : max(0, k) + 100]) for k in (0,)]
    rows += [(k, [0x55555555] * max(0, -k) + base[:20], [0x2AAAAAAA] * max(0, k) + base[:20]) for k in (-121, -120, 119, 120)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, a array<int>, b array<int>").select("k", fingerprint.alignment_score(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got[0] == 1.0 and got[-120] == got[119] == 1.0 and got[-121] < 1.0 and got[120] < 1.0


def test_numbers_without_gaps(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("recorded_at"), F.sha2(F.col("id").cast("string"), 256).alias("event_uuid"))
    got = [(r.recorded_at, r.event_uuid, r.sequence) for r in reports.numbered(rows, 10).collect()]
    assert [s for *_, s in sorted(got)] == list(range(11, 511))
    assert reports.numbered(rows.where("false"), 3).count() == 0


def test_only_stale_digests_are_read(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 3_000_000)
    rows = [("a", None, "PENDING"), ("b", "kept", "CURRENT"), ("missing", "old", "STALE")]
    got = {r.relative_path: (r.binary_hash, r.binary_hash_status) for r in adapters.with_digests(spark.createDataFrame(rows, "relative_path string, binary_hash string, binary_hash_status string"), str(tmp_path)).collect()}
    assert got["a"][1] == "CURRENT" and len(got["a"][0]) == 64 and got["b"] == ("kept", "CURRENT") and got["missing"] == (None, "FAILED")
    fp = spark.createDataFrame([('{"duration": 1.5, "fingerprint": "AQ"}',), ("no",)], "o string").select(adapters.read_fingerprint(F.col("o")).alias("f")).collect()
    assert tuple(fp[0].f) == ("AQ", 1500, None) and fp[1].f.error and adapters.fingerprint_command("x")[0] == "fpcalc"


def test_cached_analyses(spark):
    rows = [("CURRENT", "v", "1"), ("CURRENT", None, "1"), ("STALE", "v", "1"), ("CURRENT", "v", "0"), (None, "v", "1")]
    df = spark.createDataFrame(rows, "s string, v string, n string")
    got = df.select(ingest.analysis_is_current(F.col("s"), F.col("v"), F.col("n"), "1").alias("a"), ingest.analysis_is_current(F.col("s"), F.col("v")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, True), (False, False), (False, False), (False, True), (False, False)]


def test_exports_and_review(spark, tables, tmp_path):
    pairs = spark.createDataFrame([("dup_1", "fil_a", "fil_b", "PROBABLE")], "group_id string, left_file_id string, right_file_id string, classification string")
    rows = {r.group_public_id: r for r in reports.groups_export(tables["groups"], tables["members"], tables["files"], pairs).collect()}
    assert list(rows["dup_1"].asDict()) == list(reports.GROUP_FIELDS) and (rows["dup_1"].member_paths, rows["dup_1"].proposed_preferred_path) == ("p/a | p/b", "p/b")
    files = tables["files"].withColumn("public_id", F.col("file_id"))
    tiers = spark.createDataFrame([("fil_a", "fil_b", 3, False, 0.98765, 10, "COMPATIBLE"), ("fil_c", "fil_d", 1, True, None, None, "INCOMPATIBLE")], "left_id string, right_id string, tier int, same_bytes boolean, sound double, duration_delta_ms long, version_state string")
    out = reports.calibration_export(tiers, files)
    assert out.columns == list(reports.CALIBRATION_FIELDS) and {r.blocking_tier: r.chromaprint_similarity for r in out.collect()} == {"STRONG": "0.9877" if f"{0.98765:.4f}" == "0.9877" else f"{0.98765:.4f}", "WEAK": ""}
    for form in ("csv", "json"):
        review.export(out, form, f"{tmp_path}/{form}", ["left_public_id"])
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert list(lines[0]) == list(reports.CALIBRATION_FIELDS)
    entries = spark.createDataFrame([("dup_2", '{"group_id": "dup_2", "files": [{"relative_path": "</script>"}]}'), ("dup_1", '{"group_id": "dup_1", "b": 1, "a": null}')], "group_id string, entry string")
    folder = review.write_review(entries, tmp_path, "rpt_1", "rev_1", datetime(2024, 5, 6, 7, 8, 9))
    text = (folder / "manifest.json").read_text()
    whole = json.loads(text)
    assert folder.name == "duplicates-review-20240506-070809" and [g["group_id"] for g in whole["groups"]] == ["dup_1", "dup_2"]
    assert text == json.dumps(whole, indent=2, sort_keys=True)
    page = (folder / "index.html").read_text()
    assert page.count("</script>") == 2 and '"report_id": "rpt_1"' in page
    empty = review.write_review(entries.where("false"), tmp_path / "e", "rpt_1", "rev_1", datetime(2024, 5, 6))
    assert json.loads((empty / "manifest.json").read_text())["groups"] == []
    c = reports.controls(spark.createDataFrame([("B", ["mp3", "flac"]), ("A", ["mp3"]), (None, [])], "status string, formats array<string>")).first()
    assert (c.formats, c.statuses) == (["flac", "mp3"], ["A", "B"])


def test_labels(spark):
    df = spark.createDataFrame([(True, None, 1536, 61_500, 2.0), (False, True, 10, None, None)], "a boolean, b boolean, n long, ms long, x double")
    got = df.select(quality.lossless_label(F.col("a")), quality.clipping_label(F.col("b")), quality.integrity_label(F.col("a")), quality.show_bytes(F.col("n")), quality.show_duration(F.col("ms")), quality.show_number(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("LOSSLESS", "UNKNOWN", "OK", "1.5 KB", "1:02", "2.00"), ("LOSSY", "CLIPPED", "FAILED", "10 B", "-", "-")]


def test_command_line(spark, tables, tmp_path, capsys):
    root = f"file://{tmp_path}/store"
    files = tables["files"].withColumns({"is_present": F.lit(True), "size_bytes": F.lit(1).cast("long")} | {c: F.lit(1).cast("long") if c in ingest.TYPES else F.lit("t") for c in ingest.METADATA})
    Store(spark, root).commit(**{**tables, "files": files})
    run = lambda *a: cli.main(["--root", root, *a], spark)
    assert run("override", "trk_a", "artist", "New") == 0 and run("merge", "trk_b", "trk_a") == 0
    assert run("inspect", "trk_a") == 0 and json.loads(capsys.readouterr().out)["track"]["artist"] == "New"
    assert run("inspect", "fil_b") == 0 and json.loads(capsys.readouterr().out)["file"]["track_public_id"] == "trk_a"
    assert run("inspect", "dup_1") == 0 and json.loads(capsys.readouterr().out)["members"] == ["fil_a", "fil_b"]
    assert run("stats") == 0 and "tracks.merged: 1" in capsys.readouterr().out
    assert run("export", "--output", f"{tmp_path}/out") == 0 and spark.read.option("header", True).csv(f"{tmp_path}/out").columns == list(reports.CATALOG_FIELDS)
    assert run("merge", "trk_a", "trk_a") == 1 and run("inspect", "trk_none") == 1


def test_log_lines(tmp_path):
    log = logs.configure(tmp_path, -5)
    logs.run_id.set("run_1")
    log.info("hello %s", "there")
    line = json.loads((tmp_path / "kindred.log").read_text())
    assert (line["run_id"], line["message"]) == ("run_1", "hello there")
    assert logs.console_level(0) == logging.WARNING and logs.console_level(9) == logging.DEBUG
