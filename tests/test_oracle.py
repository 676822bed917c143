"""Every registered query against its SQL statement in DuckDB, at the smallest scale."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from tokenloom.plans import catalog


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 9) if not isinstance(value, (str, bool)) else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def test_every_query_has_a_statement():
    """Queries of the optional part may have none; their own tests compare them with brute force."""
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(name, spark, database):
    ours = entry.queries()[name](spark, SMALL).toPandas()
    theirs = database.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
