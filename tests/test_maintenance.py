"""Settings, run records, health checks, review entries and rebuilding."""

import json
from datetime import datetime

import pytest

from kindred import config
from kindred.operators import health, reports
from kindred.sources import journal_file, rebuild, runs


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[paths]\nmusic_root = "/m"\ndata_root = "/d"\n[duplicates.duration]\nlong_ms = 7\n')
    c = config.load(p)
    assert (str(c.music_root), c.long_ms, c.short_ms, c.review_floor) == ("/m", 7, 2000, 0.93)


def test_run_records(spark, tmp_path):
    path = str(tmp_path / "runs")
    with runs.recorded(spark, path, "scan", "scan") as run:
        run.summary["files"] = 3
    with pytest.raises(ValueError), runs.recorded(spark, path, "scan", "scan"):
        raise ValueError("broken")
    got = {(r["status"], r["summary_json"], r["error_summary"]) for r in spark.read.parquet(path).collect()}
    assert got == {("SUCCESS", '{"files": 3}', None), ("FAILED", "{}", "broken")}


def test_health(spark, tmp_path):
    assert health.root_exists(tmp_path).ok and not health.root_exists(tmp_path / "x").ok and health.data_writable(tmp_path).ok
    assert not health.data_writable(tmp_path / "x").ok and not health.root_read_only(tmp_path / "x").ok
    assert [c.ok for c in health.executables(("python", "no-such-tool"))] == [True, False]
    links = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True), (2, 2, True)], "file_id int, track_id int, is_active boolean")
    assert health.one_active_link(links) == health.Check("one_active_track", False, "2") and health.one_active_link(links.limit(2)).ok
    tracks = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "track_id int, preferred_file_id int")
    assert health.preferred_exists(tracks, links).detail == "9" and health.preferred_exists(tracks.limit(2), links).ok
    events = spark.createDataFrame([(4,)], "sequence long")
    assert health.sequence_matches(events, 4).ok and not health.sequence_matches(events.limit(0), 4).ok
    assert health.schema_current(events, "sequence long").ok and health.schema_current(events, "sequence int, x int").detail == "sequence, x"


def test_review_entries(spark):
    groups = spark.createDataFrame([(1, "REVIEW_REQUIRED"), (2, "DETECTED")], "group_id int, status string")
    files = spark.createDataFrame([(1, 6, "b", 3.0), (1, 5, "c", None), (1, 7, "a", 1.0)], "group_id int, file_id int, relative_path string, quality_score double")
    pairs = spark.createDataFrame([(1, 5, 6, "PROBABLE")], "group_id int, left_file_id int, right_file_id int, classification string")
    got = {r["group_id"]: json.loads(r["entry"]) for r in reports.manifest_groups(groups, files, pairs).collect()}
    assert [f["file_id"] for f in got[1]["files"]] == [5, 6, 7] and got[1]["quality_delta"] == 2.0 and got[1]["sort_path"] == "a"
    assert got[1]["reasons"] == [reports.PROBABLE] and got[1]["pairs"][0]["classification"] == "PROBABLE"
    assert (got[2]["files"], got[2]["pairs"], got[2]["file_count"], got[2]["reasons"]) == ([], [], 0, [reports.NO_EVIDENCE])


def test_calibration(spark):
    d = spark.createDataFrame([(1, True, 0.5), (2, False, 0.98765), (3, False, None)], "i int, same_bytes boolean, sound double")
    assert [r["sound"] for r in reports.calibration(d).orderBy("i").collect()] == ["", "0.9877", ""]


def test_rebuild(spark, tmp_path):
    links = spark.createDataFrame([("a", "s1"), ("b", "s2")], "relative_path string, track_id string")
    payload = json.dumps({"track_relative_paths": ["a"], "track_public_id": "trk", "field": "title", "value": "x"})
    journal_file.append_pending(spark.createDataFrame([(1, "TRACK_OVERRIDE_SET", "trk", payload)], journal_file.SCHEMA), str(tmp_path / "j"))
    args = (spark, links, str(tmp_path / "j"), str(tmp_path / "snapshots"))
    with pytest.raises(rebuild.RebuildError, match="root"):
        rebuild.rebuild(*args, [health.Check("root", False)], datetime(2024, 1, 1))
    assert not (tmp_path / "snapshots").exists()
    base = rebuild.rebuild(*args, [health.Check("root", True)], datetime(2024, 1, 1))
    assert {tuple(r) for r in spark.read.parquet(f"{base}/links").select("relative_path", "track_id").collect()} == {("a", "trk"), ("b", "s2")}
    assert spark.read.parquet(f"{base}/done").first()["n"] == 1
