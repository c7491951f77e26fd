"""Every query with a DuckDB twin gives the same rows."""

import glob
import math
import os

import duckdb
import pytest

from lexigrain.plans import registry


def rows(frame):
    cols = sorted(frame.columns)
    out = []
    for r in frame[cols].itertuples(index=False):
        out.append(tuple("N" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r))
    return cols, sorted(out)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, sf, con, name):
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
