"""Every query of the core against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import os

import pytest
from comparing import SF, compare, connection

from cartulary.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name])


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"x5_markdown"}
