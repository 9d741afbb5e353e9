"""Each catalogue query against its SQL in another engine."""

import duckdb
import pytest

from kindred.plans import linkage, reports  # noqa: F401 (registers its queries)
from kindred.plans.catalogue import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*cols).collect())
    r = con.execute(ORACLE[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    assert got == plain(tuple(row[names.index(c)] for c in cols) for row in r.fetchall())
