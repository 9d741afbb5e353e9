"""Small cases of the text, evidence and group functions, and of the sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from kindred.functions import evidence as E
from kindred.functions import fingerprint as FP
from kindred.functions import text as X
from kindred.operators import groups
from kindred.sources import journal_file, tables


def values(spark, column, rows):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r[0] for r in d.select(column.alias("out"), "i").orderBy("i").collect()]


def test_normal_form(spark):
    got = values(spark, X.normalize_identity(F.col("c0")), [("  A \t B ",), ("“Ｆull” – Straße",), ("x y’s",), (None,), ("",), ('say "hi"',)])
    assert got == ["a b", "full - strasse", "x y's", None, "", "say hi"]


def test_annotations(spark):
    got = values(spark, X.title_annotations(F.col("c0")), [("Song (Nalin & Kane Remix) [Remastered]",), ("Song (Part 2)",), ("A (Live) (X Mix)",), ("(Live)",), (None,)])
    assert [tuple(g) for g in got] == [("Song", "Nalin & Kane Remix", "Remastered"), ("Song (Part 2)", None, None), ("A (X Mix)", "Live", None), ("", "Live", None), (None, None, None)]


def test_filename(spark):
    got = values(spark, X.parse_filename(F.col("c0")), [("01. A – B (Dub).mp3",), ("no separator.mp3",), ("a - b - c.mp3",), (None,)])
    assert [tuple(g) for g in got] == [("A", "B", "Dub", None), (None,) * 4, (None,) * 4, (None,) * 4]


def test_featured(spark):
    got = values(spark, X.split_featured(F.col("c0")), [("A feat. B & C",), ("A (ft: B and C)",), ("feat. X",), ("Feature",), ("A feat.X",)])
    assert [(g.primary, g.featured) for g in got] == [("A", ["B", "C"]), ("A", ["B", "C"]), ("", ["X"]), ("Feature", []), ("A", [".X"])]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_ratio(spark):
    pairs = [("kitten", "sitting"), ("abc", ""), ("ab", "ba"), ("a.b|c", "a|b.c"), ("same", "same"), ("é", "e")]
    got = values(spark, X.indel_ratio(F.col("c0"), F.col("c1")), pairs)
    assert got == pytest.approx([200 * lcs(a, b) / (len(a) + len(b)) for a, b in pairs])
    assert values(spark, X.similarity(F.col("c0"), F.col("c1")), [("", None), ("a", None)]) == [1.0, 0.0]


def test_version_and_class(spark):
    assert values(spark, E.version_compatibility(F.col("c0"), F.col("c1")), [(None, ""), ("live", None), ("x mix", None), ("a", "b")]) == ["COMPATIBLE", "INCOMPATIBLE", "COMPATIBLE_WEAK", "INCOMPATIBLE"]
    c = E.classify(F.lit(False), F.lit("COMPATIBLE"), F.lit(None).cast("double"))
    assert tuple(values(spark, c, [("x",)])[0]) == ("DIFFERENT", 1.0)


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "left_id long, right_id long")
    got = {r["file_id"]: r["group_id"] for r in groups.connected_components(pairs).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert groups.connected_components(pairs.limit(0)).count() == 0


def test_journal_file(spark, tmp_path):
    path = tmp_path / "journal"
    assert journal_file.read(spark, str(path)).count() == 0
    events = spark.createDataFrame([(1, "SET", "t1", "{}"), (3, "MERGE", None, "{}"), (2, "SET", "t2", "{}")], journal_file.SCHEMA)
    assert journal_file.append_pending(events, str(path)) == 3
    assert journal_file.append_pending(events, str(path)) == 0
    assert [r["sequence"] for r in journal_file.read(spark, str(path)).collect()] == [1, 2, 3]


def test_stream_of_the_journal(spark, tmp_path):
    path = tmp_path / "journal"
    events = spark.createDataFrame([(1, "SET", "t1", "{}"), (2, "SET", "t1", "{}")], journal_file.SCHEMA)
    journal_file.append_pending(events, str(path))
    for _ in range(2):
        q = journal_file.stream(spark, str(path)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_tables(spark, tmp_path):
    d = spark.createDataFrame([(2, True, None), (1, False, 'a,"b"')], "id int, flag boolean, s string")
    tables.write_csv(d, str(tmp_path / "csv"), order_by=["id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert text.split("\n")[:3] == ["id,flag,s", '1,False,"a,""b"""', "2,True,"]
    (tmp_path / "in" / "x").mkdir(parents=True)
    for name in ("a.MP3", "b.txt", "x/c.flac"):
        (tmp_path / "in" / name).write_bytes(b"123")
    found = tables.discover(spark, str(tmp_path / "in"), ("mp3", "flac")).orderBy("relative_path").collect()
    assert [(r["relative_path"], r["size_bytes"]) for r in found] == [("a.MP3", 3), ("x/c.flac", 3)]
    assert json.loads(d.select(F.to_json(F.struct("*")).alias("j")).where("id = 1").first()["j"])["s"] == 'a,"b"'


def test_fingerprint_shift(spark):
    a = [(i * 48271) % 65536 for i in range(30)]
    d = spark.createDataFrame([(0, a, a), (1, a, a[5:]), (2, a, []), (3, None, a), (4, [0], [7]), (5, [0], [3])], "i int, l array<bigint>, r array<bigint>")
    got = [r[0] for r in d.select(FP.alignment_score(F.col("l"), F.col("r")), "i").orderBy("i").collect()]
    assert got == [1.0, 1.0, 0.0, 0.0, 0.0, 1.0]
