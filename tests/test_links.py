"""Links, and titles that meet, on records of uneven bands."""

import random

from kindred.operators import candidates, groups

COLUMNS = "file_id long, artist string, title string, duration_ms long, tol long, wtol long"


def test_links_connect_what_pairs_connect(spark):
    """Bands of any width at any duration: a wide one may reach past narrow ones."""
    rng = random.Random(7)
    rows = [(i, rng.choice([None, None, "", "a", "a", "b", "c"]), rng.choice(["old ring", "cold ring", "tin cup"]), rng.randrange(0, 60_000), rng.choice([0, 100, 400, 6000]), rng.choice([0, 100, 300, 3000])) for i in range(260)]
    df = spark.createDataFrame(rows, COLUMNS).cache()
    every, links = candidates.best_tier(df).select("left_id", "right_id").cache(), candidates.linking_pairs(df).cache()
    assert links.exceptAll(links.distinct().intersect(every)).join(every, ["left_id", "right_id"], "left_anti").isEmpty()
    found = sorted(map(tuple, groups.connected_components(links).collect()))
    assert found == sorted(map(tuple, groups.connected_components(every).collect())) and len({g for _, g in found}) > 3


def test_links_are_few(spark):
    """Records of one title, each in the band of hundreds of others, have a few links each."""
    rows = [(i, (None, "a", "b")[i % 3], "old ring", i, 9000, 9000) for i in range(600)]
    links = candidates.linking_pairs(spark.createDataFrame(rows, COLUMNS))
    assert links.count() <= 8 * 600
    assert {r.group_id for r in groups.connected_components(links).collect()} == {0}


def test_titles_of_an_artist_meet_once(spark, monkeypatch):
    """Where an artist has its titles again and again, cells are not joined; the pairs are the same."""
    rows = [(i, "a", ("old ring", "cold ring", "tin cup")[i % 3], i // 3 * 20_000, 2000, 1000) for i in range(60)]
    df = spark.createDataFrame(rows, COLUMNS)
    expected = sorted((i, i + 1) for i in range(0, 60, 3))
    monkeypatch.setattr(candidates, "_in_reach", None)
    assert sorted((r.left_id, r.right_id) for r in candidates.candidate_pairs(df).collect()) == expected


def test_compared_pairs_are_those_of_the_tiers(spark):
    """Each pair once, with what its records and names say; no id is repeated."""
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a", "a", "b"]), rng.choice(["old ring", "cold ring", "tin cup"]), rng.randrange(0, 9000), 2000, 1000) for i in range(80)]
    df = spark.createDataFrame(rows, COLUMNS).cache()
    assert not candidates.repeated_ids(df) and candidates.repeated_ids(df.union(df.limit(1)))
    of, tiers = {r[0]: r for r in rows}, {(r.left_id, r.right_id): r.tier for r in candidates.best_tier(df).collect()}
    got = candidates.compared(df, ("duration_ms",)).collect()
    assert len(got) == len(tiers) and {(r.left_id, r.right_id): r.tier for r in got} == tiers and set(tiers.values()) == {1, 2, 3}
    for r in got:
        x, y = of[r.left_id], of[r.right_id]
        assert (r.l_duration_ms, r.r_duration_ms) == (x[3], y[3]) and r.artist_similarity == float((x[1] or "") == (y[1] or ""))
        assert r.title_similarity == 1 if x[2] == y[2] else abs(r.title_similarity - 16 / 17) < 1e-9
