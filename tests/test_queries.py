"""Every registered query against its SQL, at the smallest scale."""

import pytest
from tests.conftest import DATA, same_rows

from vecframe import queries

SQL = queries.oracle_sql()


def test_every_query_has_sql():
    assert set(queries.queries()) == set(SQL)


@pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    same_rows(queries.queries()[name](spark, str(DATA / "sf0.001")), duck("sf0.001"), SQL[name])
