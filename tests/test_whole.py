"""Queries that are registered over whole tables give all rows that their SQL gives."""

import os

import pytest

from codeloom import registry
from codeloom.sources import projection
from test_queries import DIR, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def rows(spark, duck, name):  # noqa: F811
    """The query's rows, which are those of its SQL."""
    got = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracle_sql()[name])
    assert got.columns == want.columns
    order = lambda r: [(x is not None, x) for x in r]
    got = sorted(map(tuple, got.collect()), key=order)
    assert got == sorted(want.fetchall(), key=order)
    return got


def test_embedding_texts_of_all_symbols(spark, duck):  # noqa: F811
    found, symbols = rows(spark, duck, "v03_embedding_text_all"), projection.project(spark, DIR).symbols
    assert {i for i, _ in found} == {r.id for r in symbols.select("id").collect()}
    assert len(found) == symbols.count()


def test_imports_between_of_any_id(spark, duck):  # noqa: F811
    found = rows(spark, duck, "f25_import_between")
    assert any(not r[0].startswith("i-1") for r in found)
