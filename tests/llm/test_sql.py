"""Every training-data query that has SQL gives the SQL's rows at the smallest scale."""

import pytest

from pairlens.llm import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, same_rows):
    same_rows(catalog.queries()[name], SQL[name])
