"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

from oracles import ORACLES
from plumbline.plans import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"audit_coverage"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    problems = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES[name])
    assert [p for p in problems if p != "no rows"] == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
