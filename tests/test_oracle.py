"""Every registered query with SQL against DuckDB on the smallest tables; the others give rows."""

import duckdb
import pytest

from foliant.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "benchmark", "conversations")


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == float:
            frame[c] = frame[c].round(6)
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    found, wanted = registry.QUERIES[name](spark, DIR).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
