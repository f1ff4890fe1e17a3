"""Every query that SQL can state, against DuckDB on the smallest tables; the others run and have rows."""

import math
import os

import duckdb
import pytest

from tabweave.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    d = duckdb.connect()
    for t in TABLES + ["embeddings", "pages", "benchmark", "labels", "conversations"]:
        d.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return d


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    cols = sorted(df.columns)
    if name not in ORACLE:
        assert got
        return
    rel = db.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got) == want
