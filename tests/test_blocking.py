"""Tiers of candidate pairs against plain Python."""

import random

from kindred.functions import text
from kindred.operators import blocking, candidates, groups
from pyspark.sql import functions as F


def test_tiers_and_links_by_any_band(spark):
    """Bands wider than a cell, bands that differ, missing artists; copies are linked by fewer pairs."""
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "a", "a", "b"]), rng.choice([None, "", "old ring", "cold ring", "tin cup"]), rng.choice([None, 0, 290_000, 299_000, 305_000, 312_000, 650_000, 690_000])) for i in range(220)]
    df = blocking.with_tolerance(spark.createDataFrame(rows, "file_id long, artist string, title string, duration_ms long"), 2000, 12_000, 45_000).cache()
    r = [x.asDict() for x in df.collect()]
    names = sorted({x["title"] for x in r if x["title"]})
    ratio = {(x.a, x.b): x.ratio for x in spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").withColumn("ratio", text.indel_ratio(F.col("a"), F.col("b"))).collect()}
    strong, like, weak, rated = set(), set(), set(), set()
    for x in r:
        for y in r:
            if x["file_id"] >= y["file_id"] or x["duration_ms"] is None or y["duration_ms"] is None or not x["title"] or not y["title"]:
                continue
            pair, delta = (x["file_id"], y["file_id"]), abs(x["duration_ms"] - y["duration_ms"])
            if x["artist"] and x["artist"] == y["artist"] and delta <= max(x["tol"], y["tol"]):
                if x["title"] == y["title"]:
                    strong.add(pair)
                else:
                    rated.add(tuple(sorted((x["title"], y["title"]))))
                    if ratio[x["title"], y["title"]] >= 85:
                        like.add(pair)
            if x["title"] == y["title"] and any((not s["artist"] or c["artist"] is None) and delta <= s["wtol"] for s, c in ((x, y), (y, x))):
                weak.add(pair)
    assert strong and like and weak and rated
    got = lambda d: [tuple(x) for x in d.select("left_id", "right_id").collect()]
    assert sorted(got(blocking.strong_pairs(df))) == sorted(strong)
    assert sorted(got(candidates.candidate_pairs(df))) == sorted(like)
    assert sorted(got(blocking.weak_pairs(df))) == sorted(weak)
    assert sorted((x.a, x.b) for x in candidates.title_ratios(df).collect()) == sorted(rated)
    best = candidates.best_tier(df)
    assert {(x.left_id, x.right_id): x.tier for x in best.collect()} == {**dict.fromkeys(weak, 1), **dict.fromkeys(like, 2), **dict.fromkeys(strong, 3)}
    links = candidates.linking_pairs(df)
    assert set(got(links)) < set(got(best))
    assert sorted(groups.connected_components(links).collect()) == sorted(groups.connected_components(best).collect())
