"""The corpus queries that SQL can express, against their DuckDB statements (sf0.001)."""

import math

import duckdb
import pytest

from dxlens.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    found = QUERIES[name](spark, SMALL)
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    want = [tuple(map(_plain, r)) for r in result.fetchall()]
    got = [tuple(_plain(r[c]) for c in columns) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
