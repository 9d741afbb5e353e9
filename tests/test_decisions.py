"""Replay of a journal, decision files, pages and tool output."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from kindred.operators import decisions, replay, reports
from kindred.sources import adapters, html

EVENTS = "sequence long, event_type string, payload string"


def journal(spark, *events):
    return spark.createDataFrame([(i + 1, k, json.dumps(p)) for i, (k, p) in enumerate(events)], EVENTS)


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([(p, f"scan_{p}") for p in "abcdez"], "relative_path string, track_id string")


def merge(target, source, name, **relations):
    return replay.MERGE, {"target_file_relative_paths": target, "source_file_relative_paths": source, "target_track_public_id": name, "source_track_public_id": f"old_{name}", "decision_source": "HUMAN", "file_relationships": relations}


def test_replay(spark, links):
    events = journal(
        spark,
        (replay.OVERRIDE, {"track_relative_paths": ["a"], "track_public_id": "trk_a", "field": "title", "value": "x"}),
        merge(["a"], ["b"], "trk_a", b="EXACT_DUPLICATE"),
        merge(["a", "b"], ["c"], "trk_a"),
        merge(["a"], ["b"], "never"),
        (replay.SPLIT, {"moved_file_relative_paths": ["c"], "remaining_file_relative_paths": ["a", "b"], "new_track_public_id": "trk_c", "source_track_public_id": "trk_a"}),
        (replay.OVERRIDE, {"track_relative_paths": ["a", "b"], "track_public_id": "trk_a", "field": "title", "value": None}),
        ("DUPLICATE_GROUP_CONFIRMED", {"member_file_relative_paths": ["d", "e"], "decision": "CONFIRM", "preferred_file_relative_path": "e", "group_id": "dup_1"}),
        ("DUPLICATE_GROUP_REJECTED", {"member_file_relative_paths": ["a", "c"], "decision": "REJECT", "group_id": "dup_2"}),
        (replay.AUTO_PREFERRED, {"preferred_file_relative_path": "b"}),
    )
    out = replay.replay(links, events.union(events.where("sequence = 3")))
    got = {r["relative_path"]: tuple(r)[1:] for r in out.links.collect()}
    assert got == {
        "a": ("trk_a", "PRIMARY", "AUTOMATIC"),
        "b": ("trk_a", "EXACT_DUPLICATE", "HUMAN"),
        "c": ("trk_c", "PRIMARY", "HUMAN"),
        "d": ("scan_e", "AUDIO_EQUIVALENT", "HUMAN"),
        "e": ("scan_e", "PRIMARY", "AUTOMATIC"),
        "z": ("scan_z", "PRIMARY", "AUTOMATIC"),
    }
    tracks = {r["track_id"]: tuple(r)[1:] for r in out.tracks.collect()}
    assert tracks["trk_a"] == ("ACTIVE", None, "b") and tracks["trk_c"] == ("ACTIVE", None, "c")
    assert tracks["scan_d"] == ("MERGED", "scan_e", None) and tracks["scan_e"] == ("ACTIVE", None, "e")
    assert tracks["scan_z"] == ("PROVISIONAL", None, None) and out.tracks.count() == 7
    assert [tuple(r) for r in out.overrides.collect()] == [("trk_a", "title", None)]
    assert {(r["group_id"], r["status"]) for r in out.groups.collect()} == {("dup_1", "CONFIRMED"), ("dup_2", "REJECTED")}
    assert {r["event_type"]: r["n"] for r in out.counts.collect()}[replay.MERGE] == 3


@pytest.mark.parametrize("event", [
    merge(["a"], ["nowhere"], "t"),
    merge([], ["a"], "t"),
    (replay.OVERRIDE, {"track_relative_paths": ["a", "b"], "track_public_id": "t", "field": "title", "value": 1}),
    (replay.OVERRIDE, {"track_relative_paths": ["a"]}),
    ("SOMETHING", {}),
    ("DUPLICATE_GROUP_CONFIRMED", {"member_file_relative_paths": ["a"], "decision": "CONFIRM", "group_id": "g"}),
    ("DUPLICATE_GROUP_DEFERRED", {"member_file_relative_paths": [], "decision": "DEFER", "group_id": "g"}),
])
def test_replay_stops(spark, links, event):
    with pytest.raises(replay.ReplayError, match="event 1"):
        replay.replay(links, journal(spark, event))


def test_replay_bounds_and_nothing(spark, links):
    with pytest.raises(replay.ReplayError, match="more than 0"):
        replay.replay(links, journal(spark, merge(["a"], ["b"], "t")), max_events=0)
    out = replay.replay(links, spark.createDataFrame([], EVENTS))
    assert out.links.count() == 6 and out.tracks.count() == 6 and out.overrides.count() == 0


GOOD = {"schema_version": 1, "report_id": "rpt_1", "catalog_revision": "rev_1", "generated_at": "2024-01-01", "decisions": [{"group_id": "dup_1", "decision": "CHANGE_PREFERRED", "preferred_file_id": "fil_1", "reviewed_at": "now"}]}


def changed(**top):
    d = copy.deepcopy(GOOD)
    d["decisions"][0] |= top.pop("entry", {})
    for k, v in top.items():
        d[k] = v
    return d


def test_decision_file():
    assert decisions.check_file(GOOD, "rev_1") == GOOD["decisions"]
    assert decisions.check_file(changed(entry={"decision": "DEFER", "preferred_file_id": None}))
    assert decisions.check_file(changed(decisions=[])) == []
    bad = [[], {}, changed(schema_version=2), changed(report_id="x"), changed(extra=1), changed(decisions=None), changed(generated_at=""), changed(decisions=GOOD["decisions"] * 2)]
    bad += [changed(entry=e) for e in ({"decision": "NO"}, {"group_id": "x"}, {"preferred_file_id": None}, {"preferred_file_id": "x"}, {"more": 1}, {"reviewed_at": ""})]
    for d in bad:
        with pytest.raises(decisions.DecisionError):
            decisions.check_file(d)
    with pytest.raises(decisions.DecisionError, match="changed"):
        decisions.check_file(GOOD, "rev_2")


def test_page(spark):
    rows = spark.createDataFrame([(1, "</script><b>"), (2, None)], "n int, s string").coalesce(1)
    text = "".join(html.page(rows, "a<b", "now", {"n": "N", "s": "S & T"}))
    assert "<th>S &amp; T</th>" in text and "<tr><td>1</td><td>&lt;/script&gt;&lt;b&gt;</td></tr>" in text and "<tr><td>2</td><td></td></tr>" in text
    assert text.count("</script>") == 2 and '{"n":2,"s":null}' in text


def test_tools(spark):
    probe = json.dumps({"format": {"format_name": "flac", "duration": "2.0025", "bit_rate": 0}, "streams": [{"codec_type": "video"}, {"codec_type": "audio", "codec_name": "flac", "sample_rate": "44100", "bits_per_sample": 0, "bits_per_raw_sample": "16", "channels": 2, "bit_rate": "9"}]})
    d = spark.createDataFrame([(0, probe), (1, "{"), (2, "{}"), (3, None)], "i int, s string").select("i", adapters.read_probe(F.col("s")).alias("p")).orderBy("i")
    rows = [r["p"] for r in d.collect()]
    assert tuple(rows[0]) == ("flac", "flac", None, 44100, 16, 2, 2002, None)
    assert [r["error"] for r in rows[1:]] == ["invalid JSON", "no audio stream", "invalid JSON"]
    tags = spark.createDataFrame([('[{"Title": "x", "BPM": 120}]',), ("[]",)], "s string").select(adapters.read_tags(F.col("s")).alias("t")).collect()
    assert (tags[0]["t"]["title"], tags[0]["t"]["bpm"], tags[0]["t"]["artist"], tags[1]["t"]["error"]) == ("x", "120", None, "no metadata")

    def runner(argv):
        if argv[-1] == "bad":
            raise OSError("gone")
        return 0, argv[0], ""

    files = spark.createDataFrame([("ok",), ("bad",)], "path string")
    got = adapters.with_command(files, lambda p: ["tool", p], runner).select("path", "exit_code", "stdout", "error", adapters.is_intact(F.col("exit_code"), F.col("stderr")).alias("intact")).collect()
    assert {tuple(r) for r in got} == {("ok", 0, "tool", None, True), ("bad", None, None, "OSError: gone", None)}


def test_numbered(spark):
    d = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "event_uuid string, recorded_at int")
    assert [(r["event_uuid"], r["sequence"]) for r in reports.numbered(d, 7).orderBy("sequence").collect()] == [("c", 8), ("a", 9), ("b", 10)]


def test_replay_folds_connected_tracks_by_themselves(spark):
    """Each track has its own events; tracks that a split's name connects are one set."""
    owners = spark.createDataFrame([(f"p{i}", f"t{i}") for i in range(40)], "relative_path string, track_id string")
    split = [(replay.SPLIT, {"moved_file_relative_paths": [f"p{i}"], "remaining_file_relative_paths": [], "new_track_public_id": "n", "source_track_public_id": f"t{i}"}) for i in (0, 1)]
    named = [(replay.OVERRIDE, {"track_relative_paths": [f"p{i % 38 + 2}"], "track_public_id": f"t{i % 38 + 2}", "field": "title", "value": str(i)}) for i in range(90)]
    parts = replay._sets(owners, journal(spark, *split, *named)).groupBy("part").count().collect()
    assert sorted(r["count"] for r in parts)[-1] == 4 and len(parts) == 39
