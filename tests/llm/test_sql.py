"""Queries that SQL can say, against their SQL."""

from __future__ import annotations

import pytest

from ebbline.llm import queries
from tests.compare import connect, difference
from tests.conftest import SMALL

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(queries.queries()[name](spark, SMALL), connect(SMALL), SQL[name]) is None


def test_every_operator_has_one_query():
    numbers = [n[2:].split("_")[0] for n in queries.queries() if n.startswith("op")]
    assert sorted(map(int, numbers)) == sorted(set(map(int, numbers)))
    assert set(SQL) <= set(queries.queries())
