"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import connect, difference

from spanmill.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"summary_stats_approx"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert difference(df, con, SQL[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_approximate_summary_is_close(spark):
    exact = {r["project_id"]: r for r in QUERIES["summary_stats"](spark, SF).collect()}
    for row in QUERIES["summary_stats_approx"](spark, SF).collect():
        want = exact[row["project_id"]]
        assert row["total_spans"] == want["total_spans"]
        assert row["total_cost_usd"] == want["total_cost_usd"]
        assert abs(row["unique_traces"] - want["unique_traces"]) <= 0.15 * want["unique_traces"]
        assert abs(row["p95_latency_ms"] - want["p95_latency_ms"]) <= 0.1 * want["p95_latency_ms"]
