"""Every registered query against its DuckDB oracle (small scale factor for speed)."""

import pytest

from __spark_entry__ import entry
from tests.compare import compare, duckdb_connect
from scanhouse.plans.oracle import ORACLE as ORACLES
from scanhouse.plans.registry import QUERIES
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duckdb_connect(SF_SMALL)


def _assert_no_pair_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()  # final plan: df has run
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    res = compare(df, con, ORACLES[name])
    assert res["ok"], res
    _assert_no_pair_join(df)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["path", "high_count"]
    assert 0 < df.count() <= 50


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
