"""Stored sketches: merged in any order, cut at hours, within their bounds."""

import pytest
from pyspark.sql import functions as F

from spanmill.operators import overview, sketches
from spanmill.plans import derived as d

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root, spans = str(tmp_path_factory.mktemp("sketches") / "s"), d.spans(spark, SF)
    for batch in (0, 1, 2, 1):  # a batch that runs again replaces itself
        sketches.write_sketches(spans.filter(F.col("arrival_seq") % 3 == batch), root, batch)
    return sketches.read_sketches(spark, root), spans


def test_window_against_the_spans(stored):
    table, spans = stored
    start, end = "2024-01-03 05:00:00", "2024-01-21 20:00:00"
    inside = spans.filter((F.col("started_at") >= start) & (F.col("started_at") < end))
    want = {r.project_id: r for r in overview.summary_stats(inside).collect()}
    got = {r.project_id: r for r in sketches.sketched_summary(table, None, None, start, end).collect()}
    assert set(got) == set(want)
    for p, r in got.items():
        for c in ("total_spans", "error_count", "total_input_tokens", "total_output_tokens"):
            assert r[c] == want[p][c]
        assert r.total_cost_usd == pytest.approx(want[p].total_cost_usd) and r.avg_latency_ms == pytest.approx(want[p].avg_latency_ms)
        assert abs(r.unique_traces - want[p].unique_traces) <= 2 * sketches.TRACES_ERROR * want[p].unique_traces
    worst = sketches.sketch_errors(table, spans, None, start, end).agg(F.max("rank_error")).first()[0]
    assert worst <= 2 * sketches.RANK_ERROR


def test_rows_merge_by_any_dimension(stored):
    table, spans = stored
    once = sketches.usage_sketches(spans)
    assert table.count() >= once.count()
    merged = sketches.merged_sketches(table, sketches.DIMENSIONS)
    columns = [*sketches.DIMENSIONS, "spans", "errors", "latency_n", "latency_sum"]
    assert merged.select(columns).exceptAll(once.select(columns)).count() == 0 and merged.count() == once.count()
    by_agent = sketches.sketched_summary(table, ["agent_name", "status"])
    assert by_agent.agg(F.sum("total_spans")).first()[0] == spans.count()


def test_only_days_of_the_window_are_read(stored):
    table, _ = stored
    plan = sketches.sketched_summary(table, None, "p1", "2024-01-03", "2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    with pytest.raises(Exception, match="full hours"):
        sketches.sketched_summary(table, None, None, "2024-01-03 00:30:00").collect()


def test_odd_groups(spark):
    rows = [("p", None, None, "error", "t", None, "2024-01-01 00:10:00"), ("p", "m", "a", "success", None, 5, "2024-01-01 00:20:00"), (None, "m", "a", "success", "t", 5, None)]
    spans = spark.createDataFrame(rows, "project_id string, model string, agent_name string, status string, trace_id string, latency_ms int, at string")
    spans = spans.withColumns({"started_at": F.col("at").cast("timestamp"), "cost_usd": F.lit(None).cast("double"), "input_tokens": F.lit(1), "output_tokens": F.lit(None).cast("int")})
    table = sketches.usage_sketches(spans)
    got = {r.project_id: r for r in sketches.sketched_summary(table).collect()}
    assert (got["p"].total_spans, got["p"].p95_latency_ms, got["p"].unique_traces, got["p"].total_cost_usd) == (2, 5.0, 1, 0.0)
    by_model = {r.model: r for r in sketches.sketched_summary(table, ["project_id", "model"], "p").collect()}
    assert (by_model[None].p95_latency_ms, by_model[None].avg_latency_ms, by_model["m"].unique_traces) == (0.0, 0.0, 0)
    assert sketches.sketched_summary(sketches.usage_sketches(spans.limit(0))).count() == 0
