"""Every query with SQL against DuckDB, and the entry point."""

from __future__ import annotations

import importlib
import math
import sys

import pytest

from wavelattice import plans

SQL = plans.oracle_sql()


def printed(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, duck, name):
    df = plans.queries()[name](spark, data)
    columns = sorted(df.columns)
    found = sorted(tuple(printed(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert found == sorted(tuple(printed(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_other_queries_give_rows(spark, data, name):
    df = plans.queries()[name](spark, data)
    assert df.columns
    assert df.count() > 0


def test_entry_gives_rows(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_where_the_corpus_queries_cannot_be_imported(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.setitem(sys.modules, "wavelattice.llm.queries", None)
    assert set(entry.queries()) == set(plans.queries()) and set(entry.oracle_sql()) == set(SQL)
