"""Every query of the subpackage that has a SQL counterpart, on the smallest tables."""

from __future__ import annotations

import os

import pytest
from comparing import SF, compare, connection

from cartulary.llm import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    """Those without: rows and columns of the stated types."""
    found = catalog.queries()[name](spark, SF)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_names():
    assert {f"p{n}_found" for n in (2, 3, 4, 5, 8)} | {"p6_ids"} <= set(catalog.queries())
