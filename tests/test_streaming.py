"""The journal as a stream."""

from kindred.sources import journal_file
from kindred.streaming.journal import follow


def test_a_copy_follows_the_journal(spark, tmp_path):
    rows = lambda *n: spark.createDataFrame([(i, "TRACK_MERGE", "t", "{}") for i in n], journal_file.SCHEMA)
    journal, copy = f"{tmp_path}/journal", f"{tmp_path}/copy"
    step = lambda: (follow(spark, journal, copy, f"{tmp_path}/mark"), sorted(r.sequence for r in spark.read.schema(journal_file.SCHEMA).json(copy).collect()))[1]
    journal_file.append_pending(rows(1, 2), journal)
    assert step() == [1, 2] and step() == [1, 2]
    journal_file.append_pending(rows(1, 2, 3), journal)
    assert step() == [1, 2, 3]
