"""Every registered job (the corpus queries are tested in tests/llm) against its DuckDB oracle statement (sf0.001)."""

import collections
import math

import duckdb
import pytest

import __spark_entry__ as entry
from dxlens import oracle
from dxlens.plans.catalog import QUERIES

from .conftest import SMALL

TABLES = ["part", "orders", "lineitem", "events"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if v is not None and hasattr(v, "isoformat") and not isinstance(v, str):
        return str(v).replace("T", " ")
    if hasattr(v, "as_tuple"):
        return str(v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_every_job_has_an_oracle_and_is_registered():
    assert set(QUERIES) == set(oracle.all_sql())
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    cols = df.columns
    got = collections.Counter(tuple(_norm(v) for v in r) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    want = collections.Counter(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert sum(got.values()) == sum(want.values())
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 1500
