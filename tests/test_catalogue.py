"""Every catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from strataloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 9)
    return x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(name, spark, sf, con):
    got = catalogue.QUERIES[name](spark, sf)
    want = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(norm, r)) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_run(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
