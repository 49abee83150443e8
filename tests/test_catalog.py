"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from snapgrain.plans import composites, evidence, panel  # noqa: F401
from snapgrain.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v) + 0.0:.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())


# multinomial_signals is run by q16_signal_classes
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"multinomial_signals"}))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
