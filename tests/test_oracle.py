"""Every registered query against its SQL oracle (DuckDB) on the smallest scale factor."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _key(r):
    return tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    idx = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=_key)
    assert cols == sorted(dcols)
    assert rows == drows


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and not any(all(v is None for v in r) for r in rows)


def test_entry(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"party", "topic_votes", "party_mentions", "total_votes", "pct"}
    assert df.count() == 7
