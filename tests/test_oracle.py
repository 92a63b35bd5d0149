"""Every registered query gives what its SQL gives."""

from __future__ import annotations

import pytest
from paths import SMALL
from oracle_check import connect, difference

from paperloom.plans.catalog import ORACLE, REGISTRY


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    assert difference(con, spark, REGISTRY[name], ORACLE[name], SMALL) is None
