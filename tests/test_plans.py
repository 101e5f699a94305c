"""Physical plans: what is read, shuffled and cut early."""

import re

import pytest
from pyspark.sql import functions as F

from spanmill.functions.pii import scrub_pii
from spanmill.operators import alerts, errors, lifecycle, overview, rollup, search, traces
from spanmill.plans import derived as d
from spanmill.sources import batches
from spanmill.streaming import jobs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Spans in the layout of the sink."""
    path = str(tmp_path_factory.mktemp("plans") / "spans")
    batches.spans_sink(d.spans(spark, SF), path)
    return batches.read_spans(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    """Column names that each file scan reads."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    return [{column.split(":")[0] for column in schema.split(",")} for schema in schemas]


TEXTS = {"input", "output", "metadata"}


def test_reports_read_no_texts(stored):
    for df in (
        overview.summary_stats(stored, None, d.START, d.END),
        overview.model_usage(stored),
        overview.top_agents(stored),
        errors.error_clusters(stored),
        alerts.alert_metrics(stored, d.AS_OF),
        lifecycle.retention_report(stored, d.projects(stored.sparkSession), d.AS_OF),
    ):
        read = scans(df)
        assert read and not any(columns & TEXTS for columns in read)


def test_filters_reach_the_scan(stored):
    text = plan(overview.summary_stats(stored, "p1", d.START, d.AS_OF))
    assert re.search(r"PartitionFilters: \[[^\]]*project_id", text)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(started_at", text)


def test_top_rows_are_cut_before_the_shuffle(stored):
    for df in (errors.error_clusters(stored), jobs.latest_feed(jobs.stream_live_feed(stored))):
        assert "WindowGroupLimit" in plan(df) and "Partial" in plan(df)
    assert "TakeOrderedAndProject" in plan(overview.recent_errors(stored, "p0"))
    listed = traces.list_traces(rollup.finish_traces(rollup.trace_partials(stored)), project_id="p0")
    assert "TakeOrderedAndProject" in plan(traces.trace_page(listed))


def test_aggregates_combine_before_the_shuffle(stored):
    text = plan(rollup.trace_partials(stored))
    assert text.count("Aggregate") >= 2 and text.count("Exchange hashpartitioning") == 1
    volume = plan(overview.model_usage_pg(stored))
    assert "partial_count" in volume


def test_row_work_does_not_shuffle(spark, stored):
    for df in (scrub_pii(stored), d.compute_cost(stored), search.matching_spans(stored, "weather")):
        assert "Exchange hashpartitioning" not in plan(df) and "SortMergeJoin" not in plan(df)
        assert "Python" not in plan(df)


def test_narrow_repeated_ids_are_broadcast(stored):
    from spanmill.operators.enrich import insert_spans_first_wins

    assert insert_spans_first_wins(stored) is stored  # no id is repeated
    text = plan(insert_spans_first_wins(stored.unionAll(stored.filter("arrival_seq % 31 = 0"))))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_one_hot_trace(spark):
    """A trace with nearly all spans: right totals, and only partial rows are shuffled."""
    n = 50_000
    spans = spark.range(n).select(
        F.concat(F.lit("s"), "id").alias("span_id"),
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("t"), "id")).otherwise("hot").alias("trace_id"),
        F.when(F.col("id") > 1, F.lit("s1")).alias("parent_span_id"),
        F.lit("p").alias("project_id"),
        F.concat(F.lit("n"), "id").alias("name"),
        F.lit(1).alias("input_tokens"),
        F.lit(1).alias("output_tokens"),
        (F.col("id") % 100).cast("int").alias("latency_ms"),
        F.lit(0.5).alias("cost_usd"),
        F.lit("success").alias("status"),
        F.lit("{}").alias("metadata"),
        F.timestamp_seconds("id").alias("started_at"),
        F.timestamp_seconds(F.col("id") + 1).alias("ended_at"),
        F.col("id").alias("arrival_seq"),
    )
    hot = rollup.trace_rollup(spans).filter("trace_id = 'hot'").first()
    assert (hot["total_spans"], hot["agent_name"]) == (n - n // 50, "n1")
    from spanmill.operators.tree import trace_tree

    placed = trace_tree(spans)
    assert placed.count() == n and placed.filter("depth = 1").count() == n - n // 50 - 1
