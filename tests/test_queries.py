"""Registered queries against DuckDB at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry
from sightline.plans import queries as site
from sightline.plans import site_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(df, oracle):
    columns = sorted(df.columns)
    assert columns == sorted(oracle.columns)
    rows = [sorted(map(str, x[columns].itertuples(index=False, name=None))) for x in (df, oracle)]
    return rows[0] == rows[1]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(site.ORACLE))
def test_query(spark, duck, name):
    df = site.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(site.ORACLE[name]).fetchdf()
    assert len(df) == len(want)
    kinds = {c: want[c].dtype for c in df.columns}
    assert same(df.astype({c: k for c, k in kinds.items() if str(k).startswith(("int", "float")) and not df[c].isna().any()}), want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
