"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest

from compare import differences, duck
from trackloom.plans.oracles import ORACLES
from trackloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_twin(spark, con, name):
    assert not differences(spark, con, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_a_twin_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_all_twins_have_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
