"""Every registered query against its DuckDB twin, and the shape of every plan."""

import pytest

from barlab.plans import ALL_QUERIES
from checks.compare import connect, difference
from checks.oracle import ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(ALL_QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, con, name):
    assert difference(name, spark, SF, ALL_QUERIES[name], ORACLE_SQL[name], con) is None


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(set(ALL_QUERIES) - {"fit_boosted"}))
def test_no_pairwise_join(spark, name):
    plan = plan_of(ALL_QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_prunes_columns_and_pushes_dates(spark):
    plan = plan_of(ALL_QUERIES["date_range_scan"](spark, SF))
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1].split("\n")[0]
