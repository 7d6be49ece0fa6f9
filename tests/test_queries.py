"""Every engine query with SQL gives the SQL's rows on the smallest tables."""

import glob
import math

import duckdb
import pytest

from gyrolens.plans import oracle, queries

SF = "/root/testdata/sf0.001"


#: These find nothing in the smallest tables, and run over the next ones.
LARGER = {"har_features": "/root/testdata/sf0.01", "pdr_peaks": "/root/testdata/sf0.01"}


def duck(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, columns):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v if isinstance(v, (bool, str)) else float(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, name):
    folder = LARGER.get(name, SF)
    got = queries.queries()[name](spark, folder)
    want = duck(folder).execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = want.fetchall()
    assert plain(got.collect(), got.columns) == plain(rows, columns) and rows  # two empty sides would agree on nothing


def test_every_sql_has_a_query():
    assert oracle.oracle_sql().keys() <= queries.queries().keys()
