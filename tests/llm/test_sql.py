"""Rows equal those of SQL on DuckDB, where an operator or a part of it has some."""

import pytest

from spanveil.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_sql(spark, small, name):
    got = (queries.queries() | queries.parts())[name](spark, small).toPandas()
    want = oracle.expected(queries.oracle_sql()[name], small)
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows(got) == oracle.rows(want)
