"""Every registered table against its SQL on the small order tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from ebbline import oracle  # noqa: E402
from ebbline.plans import registry  # noqa: E402
from tests.compare import connect, difference  # noqa: E402
from tests.conftest import SMALL  # noqa: E402

QUERIES, ORACLE = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SMALL), duck, ORACLE[name]) is None


def test_entry_returns_train_and_test_accuracy(spark):
    assert {r.data for r in contract.entry(spark).collect()} == {"Train", "Test"}
