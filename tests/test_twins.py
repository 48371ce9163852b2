"""Every query with SQL against DuckDB, on a whole small data set."""

import pytest

import __spark_entry__ as entry
from tests.util import rows, spark_rows

_SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(_SQL))
def test_twin(spark, duck, folder, name):
    found = entry.queries()[name](spark, folder)
    expected = duck.execute(_SQL[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(found.columns)
    assert spark_rows(found) == rows(names, expected.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(_SQL) <= set(entry.queries())
