"""The registered queries against their SQL, on the smallest data."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check import compare
from workload import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(FOLDER).is_dir():
        pytest.skip("no test data")
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    text, _, _ = compare(spark, con, name, FOLDER)
    assert text.startswith(("ok", "rows only")), text


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
