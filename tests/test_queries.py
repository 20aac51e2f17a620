"""Every catalog query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from reelspark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].astype(float).round(6)
            if (df[c].dropna() % 1 == 0).all():
                df[c] = df[c].astype("Int64")
    text = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    out = pd.DataFrame({c: [text(v) for v in df[c]] for c in df.columns}, dtype=object)
    return out.sort_values(by=list(out.columns), key=lambda s: s.map(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf, db):
    got, want = canonical(QUERIES[name](spark, sf).toPandas()), canonical(db.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() >= 0 and "bd_rate" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
