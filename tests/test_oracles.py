"""Every query with a SQL twin gives exactly the twin's rows on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry_file
from tagsmith.workload import oracles, queries as workload

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
QUERIES, ORACLES = workload.registered(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


#: Default sizes on any table: minutes of small jobs. Run with --slow.
MINUTES = {"train_gbt", "tune_random", "tune_grid"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal(spark, sf, duck, name, request):
    if name in MINUTES and not request.config.getoption("--slow"):
        pytest.skip("needs --slow")
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    twin = duck.sql(ORACLES[name])
    assert sorted(twin.columns) == columns
    kinds = dict(zip(twin.columns, map(str, twin.types)))
    assert {c: TYPES[t] for c, t in frame.dtypes} == kinds
    order = [twin.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in twin.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    assert entry_file.entry(spark).count() > 0
