"""Every registered query of the replication engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark import catalogue, catalogue_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(names, found):
    """Rows with their columns by name, numbers made alike, in any order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted([*catalogue.ORACLES, *catalogue.RULES]))
def test_query_equals_sql(spark, db, name):
    run, sql = catalogue.RULES[name] if name in catalogue.RULES else (catalogue.QUERIES[name], catalogue.ORACLES[name])
    got = run(spark, SF)
    said = db.execute(sql)
    names = [c[0] for c in said.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, said.fetchall())


def test_all_queries_have_sql():
    assert catalogue_rules and set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert len(catalogue.RULES) == 21 and not set(catalogue.RULES) & set(catalogue.QUERIES)
