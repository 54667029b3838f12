from __future__ import annotations

import pytest

import __spark_entry__
from quillcheck.plans import registry

from .oracle import DATA, connection, rows_of, rows_of_sql

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, con, name):
    assert rows_of(registry.QUERIES[name](spark, str(DATA))) == rows_of_sql(con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
