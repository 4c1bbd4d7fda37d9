"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import datetime as dt

import duckdb
import pytest

from __spark_entry__ import entry
from oracle.sql import oracle_queries
from proxyscope.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    return str(v)


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle_queries())


@pytest.mark.parametrize("name", sorted(oracle_queries()))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = _bag(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(oracle_queries()[name])
    want = _bag([d[0] for d in res.description], res.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in res.description)
    assert got == want


def test_entry_smoke(spark):
    rows = entry(spark).collect()
    assert len(rows) == 11 and all(r.doc.startswith("{") for r in rows)
