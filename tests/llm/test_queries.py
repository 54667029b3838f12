from __future__ import annotations

import pytest

from quillcheck.llm import queries

from ..oracle import DATA, connection, rows_of, rows_of_sql

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert rows_of(queries.queries()[name](spark, str(DATA))) == rows_of_sql(connection(), queries.oracle_sql()[name])
