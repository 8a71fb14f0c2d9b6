"""Registered queries against their SQL over the driver's smallest tables: every sixth, or all with CODELOOM_ALL=1."""

import os

import pytest

from codeloom import registry

DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES if os.environ.get("CODELOOM_ALL") else NAMES[::6])
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DIR).toArrow()
    want = duck.sql(registry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    duck.register("got", got.select(columns))
    duck.register("want", want.select(columns))
    assert duck.execute("select * from got except all select * from want").fetchall() == []
    assert duck.execute("select * from want except all select * from got").fetchall() == []


def test_queries_have_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == set()
