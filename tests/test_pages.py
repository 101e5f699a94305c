"""Overview and cost page: every part equals the report behind it, from a few scans."""

import re

import pytest
from pyspark.sql import functions as F

from spanmill.functions.stats import js_round
from spanmill.operators import cost, overview, page
from spanmill.plans import derived as d
from spanmill.sources import batches

SF = "/root/testdata/sf0.001"
START, END = "2024-01-01 00:00:00", d.AS_OF


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "spans")
    batches.spans_sink(d.spans(spark, SF), path)
    return batches.read_spans(spark, path)


def shown(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return [shown(v) for v in value]
    return value


def by_project(df, *columns, order):
    """{project: rows of a report as lists}, in the order of the page."""
    out = {}
    for row in df.orderBy("project_id", *order).select("project_id", *columns).collect():
        out.setdefault(row[0], []).append(shown(row[1:]))
    return out


def test_overview_equals_its_reports(spark, stored):
    args, traces = (None, F.lit(d.AS_OF).cast("timestamp") - F.expr("INTERVAL 168 HOURS"), d.AS_OF), d.traces(spark, SF)
    got = {r["project_id"]: r for r in overview.overview(stored, traces, None, d.AS_OF, 168).collect()}
    agents = overview.top_agents(stored, *args).withColumn("avg_latency_ms", js_round(F.col("avg_latency_ms")))
    parts = {
        "hourly_volume": by_project(overview.hourly_volume(stored, *args), "hour", "total", "errors", order=["hour"]),
        "model_usage": by_project(overview.model_usage(stored, *args), "model", "calls", "cost_usd", order=[F.desc("calls"), "model"]),
        "top_agents": by_project(agents, "agent_name", "trace_count", "error_count", "avg_latency_ms", "cost_usd", order=[F.desc("trace_count"), "agent_name"]),
        "recent_errors": by_project(
            overview.recent_errors(stored, *args), "trace_id", "error_message", "agent_name", "model", "started_at", order=[F.desc("started_at"), "trace_id"]
        ),
        "error_clusters": by_project(
            overview.error_clusters(stored, *args), "pattern", "count", "trace_ids", "models", "last_seen", order=[F.desc("span_count"), "pattern"]
        ),
    }
    assert len(got) > 1
    for name, want in parts.items():
        assert want and {p: shown(r[name]) for p, r in got.items() if r[name] is not None} == want, name
    scalars = overview.combined(
        ["project_id"], overview.prev_window_summary(stored, None, d.AS_OF, 168), overview.month_to_date_cost(stored, None, d.AS_OF),
        overview.summary_stats(stored, *args).select("project_id", "total_cost_usd", *[js_round(F.col(c)).alias(c) for c in ("avg_latency_ms", "p95_latency_ms")]),
        overview.active_traces(traces),
    )
    names = [c for c in scalars.columns if c != "project_id"]
    want = {r["project_id"]: shown([r[c] for c in names]) for r in scalars.collect()}
    assert {p: shown([r[c] for c in names]) for p, r in got.items()} == want


def test_cost_page_equals_its_reports(spark, stored):
    args = (stored, None, START, END)
    got = {r["project_id"]: r for r in cost.cost_summary(stored, d.projects(spark), None, START, END).collect()}
    names = ["model", "provider", "cost_usd", "span_count", "avg_tokens_per_call", "avg_cost_per_call", "avg_latency_ms", "call_count"]
    parts = {
        "by_model": by_project(cost.cost_by_model(*args), *names, order=[F.desc("call_count"), "model"]),
        "by_date": by_project(cost.cost_by_date(*args), "date", "cost_usd", order=["date"]),
        "by_agent": by_project(cost.cost_by_agent(*args), "agent_name", "cost_usd", order=["agent_name"]),
    }
    assert len(got) > 1
    for name, want in parts.items():
        assert want and {p: shown(r[name]) for p, r in got.items() if r[name] is not None} == want, name
    totals = cost.period_costs(*args)
    want = {r["project_id"]: shown([r[c] for c in totals.columns]) for r in totals.collect()}
    assert {p: shown([r[c] for c in totals.columns]) for p, r in got.items()} == want


def test_one_project(spark, stored):
    whole = {r["project_id"]: r for r in overview.overview(stored, d.traces(spark, SF), None, d.AS_OF, 168).collect()}
    (row,) = overview.overview(stored, d.traces(spark, SF), "p1", d.AS_OF, 168).collect()
    assert all(shown(row[c]) == shown(whole["p1"][c]) for c in row.__fields__)
    (nothing,) = overview.overview(stored, d.traces(spark, SF), "absent", d.AS_OF).collect()
    assert not any(nothing) and nothing["model_usage"] == [] and nothing["total_requests"] == 0
    (nothing,) = cost.cost_summary(stored, d.projects(spark), "absent", START, END).collect()
    assert nothing["monthly_budget_usd"] is None and nothing["total_cost_usd"] == 0 and nothing["by_date"] == []


def test_scans_of_the_stored_spans(spark, stored, monkeypatch):
    """The pages scan the spans three times and once, and never the texts."""
    plans, write = [], overview.written
    place = re.escape(stored.inputFiles()[0].split("/spans/")[0].split("/")[-1])

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def noted(df, name, *columns):
        plans.append(text(df))
        return write(df, name, *columns)

    def reads():
        return [line for line in "\n".join(plans).split("\n") if "FileScan parquet" in line and re.search(place, line)]

    monkeypatch.setattr(overview, "written", noted)
    monkeypatch.setattr(cost, "written", noted)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plans.append(text(overview.overview(stored, d.traces(spark, SF), None, d.AS_OF, 168)))
        assert len(reads()) == 3 and not any(re.search(r"\b(input|output|metadata):", line) for line in reads())
        plans.clear()
        plans.append(text(cost.cost_summary(stored, d.projects(spark), None, START, END)))
        assert len(reads()) == 1
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_magnitude_ascends(spark):
    numbers = sorted({-5, -1, *range(0, 3000), *(2**k + e for k in range(12, 62) for e in (-1, 0, 1)), 2**63 - 1})
    df = spark.createDataFrame([(n,) for n in numbers], "v long").select("v", page.magnitude(F.col("v")).alias("b"))
    found = [r["b"] for r in df.orderBy("v").collect()]
    assert found == sorted(found) and found[2:130] == list(range(128))


@pytest.mark.parametrize("size", [1, 2, 19, 20, 21, 22, 1000])
def test_percentile_of_buckets(spark, size):
    """One and two buckets around the rank, repeats, null values, a null project."""
    rows = spark.range(size).select(
        F.explode(F.array(F.lit("a"), F.lit(None))).alias("project_id"),
        F.when(F.col("id") % 7 != 3, F.pmod(F.xxhash64("id"), F.lit(size * size + 1))).cast("int").alias("v"),
    )
    buckets = rows.filter("v IS NOT NULL").groupBy("project_id", page.magnitude(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))
    got = {r[0]: r[1] for r in page.percentile_of_buckets(buckets, rows, "v", 0.95, "p").collect()}
    want = {r[0]: r[1] for r in rows.groupBy("project_id").agg(F.expr("percentile(v, 0.95)").alias("p")).collect()}
    assert got == pytest.approx(want)
