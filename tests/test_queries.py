"""Every registered query that SQL can express equals its SQL; the others run."""

import pytest
from oracle import SF, connection, rows

from lodestack.plans import queries as core


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_equals_sql(spark, con, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), con.execute(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry_works_without_the_optional_parts(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    assert set(core.QUERIES) <= set(entry.queries()) and not any(k.startswith("op") for k in entry.queries())
    assert entry.entry(spark).count() > 0
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
