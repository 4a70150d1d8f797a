"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import SF, duck, rows

from helixframe.plans.catalogue import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck().sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
