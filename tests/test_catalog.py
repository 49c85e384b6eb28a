"""Every catalog query with a SQL form against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from waveline import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(plain(v) for v in row) for row in found.fetchall()), key=repr)
    assert sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=repr) == expected


def rows_of_keys(tmp_path, keys):
    """A folder whose line items have these supplier keys, and a connection to it."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest({keys})::BIGINT AS l_suppkey, unnest(range({len(keys)}))::INT % 7 AS l_linenumber) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    return con


@pytest.mark.parametrize("name", ["tokenize_keys", "key_file_roundtrip"])
def test_frequencies_have_no_domain(spark, tmp_path, name):
    con = rows_of_keys(tmp_path, [0, 5, 5, 1022, 1023, 1024, 1024, 59_999, 10**12] * 3)
    df = catalog.queries()[name](spark, str(tmp_path))
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(tuple(row[n] for n in names) for row in df.collect()) == sorted(found.fetchall())
