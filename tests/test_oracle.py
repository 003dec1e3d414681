"""Every registered query with an oracle equals its DuckDB statement on sf0.001."""

import pytest

import __spark_entry__ as E
from shoplens.checks.compare import digest, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    r = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in r.description]
    drows = r.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert digest(df.columns, [tuple(x) for x in df.collect()]) == digest(dcols, drows)
    # the column types agree as well
    types = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE",
             "boolean": "BOOLEAN"}
    dtypes = {r[0]: r[1] for r in con.execute(f"DESCRIBE {E.oracle_sql()[key]}").fetchall()}
    assert {c: types.get(t, t) for c, t in df.dtypes} == dtypes


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "conversion_rate" in df.columns
