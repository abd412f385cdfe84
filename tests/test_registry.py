"""Every registered query against its DuckDB counterpart on the smallest driver tables."""

import decimal
import math
import os

import duckdb
import pytest

from tillwise.registry import oracle
from tillwise.registry.queries import queries
from tillwise.sources.readers import jdbc_options

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not available")


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, tables, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    result = tables.execute(SQL[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted([_plain(row[p]) for p in places] for row in result.fetchall())
    assert sorted([_plain(row[c]) for c in columns] for row in got.collect()) == expected


def test_jdbc_options_split_the_read():
    assert jdbc_options("jdbc:x", "ps_orders") == {"url": "jdbc:x", "dbtable": "ps_orders", "fetchsize": "10000"}
    split = jdbc_options("jdbc:x", "ps_orders", ("id_order", 1, 100, 8), user="u")
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == (
        "id_order", "1", "100", "8"
    )
    assert split["user"] == "u"
