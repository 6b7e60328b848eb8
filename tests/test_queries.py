"""Every registered query against its SQL, on whole tables."""

import pytest
from compare import differences, duck, duck_rows, spark_rows

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, folder, connection, name):
    columns, rows = spark_rows(entry.queries()[name](spark, folder))
    if name in SQL:
        want_columns, want = duck_rows(connection, SQL[name])
        assert columns == want_columns
        assert len(rows) == len(want)
        assert differences(rows, want) == []
    else:
        assert columns


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
