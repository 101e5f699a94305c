"""Streams: equal to the batch, safe to run again, fed by several files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from spanmill.operators.rollup import trace_rollup
from spanmill.session import shared_dir, work_path
from spanmill.sources import batches, tables
from spanmill.streaming import jobs

UUID = "00000000-0000-4000-8000-000000000000"


def wire(i, **kw):
    return {
        "spanId": f"s{i}", "traceId": f"t{i // 3}", "projectId": UUID, "name": f"n{i % 3}", "status": "success",
        "startedAt": f"2024-01-01T00:{i % 60:02d}:00Z", "provider": "openai", "model": "gpt-4o",
        "inputTokens": 1000, "outputTokens": 500, "input": f"mail me{i}@example.com",
        **({} if i % 3 == 0 else {"parentSpanId": f"s{i - i % 3}"}), **kw,
    }


def write_file(path, name, spans):
    (path / name).write_text(json.dumps({"spans": spans}) + "\n")


def run_ingest(spark, source, root, checkpoint, **options):
    raw = batches.read_span_batches(spark, str(source), streaming=True, **options)
    jobs.stream_ingest(raw, root, checkpoint, interval=None).awaitTermination()


def stored(spark, root, name="spans"):
    path = f"{root}/{name}"
    return spark.read.option("basePath", path).parquet(path)


def test_ingest_over_several_runs(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    bad = {**wire(90), "name": ""}
    write_file(source, "a.json", [wire(i) for i in range(6)] + [bad, wire(5)])
    run_ingest(spark, source, root, checkpoint)
    write_file(source, "b.json", [wire(i) for i in range(6, 9)] + [wire(100, parentSpanId="s99", traceId="t0")])
    run_ingest(spark, source, root, checkpoint)
    rows = {r["span_id"]: r for r in stored(spark, root).collect()}
    assert set(rows) == {f"s{i}" for i in [*range(9), 100]}
    assert rows["s4"]["input"] == "mail [REDACTED-EMAIL]" and rows["s4"]["cost_usd"] == 0.0075
    assert rows["s4"]["agent_name"] == "n0"
    rejects = stored(spark, root, "rejects").collect()
    assert [(r["span_id"], r["reasons"]) for r in rejects] == [("s90", ["name"])]
    traces = {r["trace_id"]: r for r in tables.read_traces(spark, f"{root}/trace_partials").collect()}
    assert {t: r["total_spans"] for t, r in traces.items()} == {"t0": 4, "t1": 3, "t2": 3}
    # A batch that is run again replaces its own rows.
    raw = batches.read_span_batches(spark, str(source / "b.json"))
    jobs.ingest_micro_batch(raw, 1, root)
    assert not (tmp_path / "out" / "staged" / "ingest_batch=1").exists()
    assert stored(spark, root).count() == 10
    assert {r["trace_id"]: r["total_spans"] for r in tables.read_traces(spark, f"{root}/trace_partials").collect()} == {
        "t0": 4, "t1": 3, "t2": 3,
    }


def test_ingest_is_idempotent_across_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    write_file(source, "a.json", [wire(0), wire(1)])
    run_ingest(spark, source, root, checkpoint)
    bad = wire(3, name="", input="write to bad@example.com")
    offset = wire(4, startedAt="2024-01-01T00:04:00+00:00")
    write_file(source, "b.json", [wire(1, latencyMs=9), wire(2), bad, offset])
    run_ingest(spark, source, root, checkpoint)
    rows = {r["span_id"]: r for r in stored(spark, root).collect()}
    assert sorted(rows) == ["s0", "s1", "s2"] and stored(spark, root).count() == 3
    assert rows["s1"]["latency_ms"] is None  # the first delivery stays
    assert rows["s2"]["agent_name"] == "n0"  # from the root of the earlier batch
    totals = tables.read_traces(spark, f"{root}/trace_partials").collect()
    assert [(r["trace_id"], r["total_spans"]) for r in totals] == [("t0", 3)]
    rejects = {r["span_id"]: r["payload"] for r in stored(spark, root, "rejects").collect()}
    assert sorted(rejects) == ["s3", "s4"] and "bad@example.com" not in rejects["s3"]
    raw = batches.read_span_batches(spark, str(source / "b.json"))
    jobs.ingest_micro_batch(raw, 2, root, allow_offset=True)
    assert {r["span_id"] for r in stored(spark, root).collect()} == {"s0", "s1", "s2", "s4"}


def test_sequence_numbers_of_many_tasks(spark):
    rows = spark.range(0, 600, 1, 300).withColumn("_row", F.monotonically_increasing_id())
    numbers = [[r["arrival_seq"] for r in jobs._numbered(rows, n).collect()] for n in (1, 2)]
    assert sorted(numbers[0]) == [(1 << 40) + k for k in range(600)]
    assert max(numbers[0]) < min(numbers[1])


def test_numbers_reach_the_spans_without_a_shuffle(spark):
    """The sizes of the tasks are broadcast, also if the spans are beyond the planner's threshold."""
    rows = spark.range(0, 600, 1, 300).withColumn("_row", F.monotonically_increasing_id())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jobs._numbered(rows, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_failures_fire_in_the_stream(spark, tmp_path):
    from decimal import Decimal as D

    base = dt.datetime(2024, 1, 1)
    alerts = spark.createDataFrame(
        [("a", "p", "failure", D("1"), True)],
        "alert_id string, project_id string, type string, threshold decimal(10,4), is_active boolean",
    )
    spans = [(f"s{k}", f"t{k}", None, "p", "n", 1, 1, 1, 0.0, "error", "{}", k, base + dt.timedelta(minutes=m))
             for k, m in enumerate((1, 2, 6, 11, 12, 13, 31, 32))]
    schema = """span_id string, trace_id string, parent_span_id string, project_id string, name string,
        input_tokens int, output_tokens int, latency_ms int, cost_usd double, status string,
        metadata string, arrival_seq long, started_at timestamp"""
    frame = spark.createDataFrame(spans, schema).withColumn("ended_at", F.col("started_at"))
    traces_root, root = str(tmp_path / "partials"), str(tmp_path / "firings")
    tables.write_trace_partials(frame, traces_root, 0)
    metrics = jobs.stream_alert_metrics(frame)
    for n, low in enumerate((0, 30)):
        part = metrics.filter((F.col("tick") > base + dt.timedelta(minutes=low)) & (F.col("tick") <= base + dt.timedelta(minutes=low + 30)))
        jobs.cooldown_micro_batch(part, n, alerts, root, traces_root=traces_root)
    fired = stored(spark, str(tmp_path), "firings").orderBy("tick").collect()
    assert [((r["tick"] - base).total_seconds() / 60, r["value"]) for r in fired] == [(5, 2.0), (35, 2.0)]


def test_partials_compact_to_the_same_traces(spark, tmp_path):
    rows = [(f"s{i}", f"t{i % 4}", None if i < 4 else "x", "p", f"n{i}", 1, 1, 1, 0.5, "success", "{}", i) for i in range(40)]
    spans = spark.createDataFrame(
        rows,
        """span_id string, trace_id string, parent_span_id string, project_id string, name string,
        input_tokens int, output_tokens int, latency_ms int, cost_usd double, status string,
        metadata string, arrival_seq long""",
    ).withColumns({"started_at": F.timestamp_seconds("arrival_seq"), "ended_at": F.timestamp_seconds("arrival_seq")})
    root, target = str(tmp_path / "p"), str(tmp_path / "c")
    for k in range(4):
        tables.write_trace_partials(spans.filter(F.col("arrival_seq") % 4 == (k + F.col("arrival_seq") % 3) % 4), root, k)
    before = sorted(map(str, tables.read_traces(spark, root).collect()))
    for _ in range(2):  # run again, it doubles nothing
        tables.compact_trace_partials(spark, root, target, 2)
    assert sorted(map(str, tables.read_traces(spark, target).collect())) == before


def test_landed_batches_move_to_the_table(spark, tmp_path):
    landing, target = str(tmp_path / "l"), str(tmp_path / "t")
    spans = spark.createDataFrame([("a", "p"), ("b", "q")], "span_id string, project_id string").withColumn(
        "started_at", F.lit("2024-01-01").cast("timestamp")
    )
    for k in range(2):
        tables.write_batch(spans.withColumn("date", F.to_date("started_at")), landing, k, "project_id", "date")
    for _ in range(2):
        tables.compact_spans(spark, landing, target, 0, 0)
    tables.compact_spans(spark, landing, target, 1, 1)
    got = batches.read_spans(spark, target)
    assert sorted((r["span_id"], r["project_id"]) for r in got.collect()) == [("a", "p"), ("a", "p"), ("b", "q"), ("b", "q")]
    assert "landed" not in got.columns


def test_cooldown_across_micro_batches(spark, tmp_path):
    from decimal import Decimal as D

    base = dt.datetime(2024, 1, 1)
    alerts = spark.createDataFrame(
        [("a", "p", "error_rate", D("10"), True)],
        "alert_id string, project_id string, type string, threshold decimal(10,4), is_active boolean",
    )

    def metrics(*minutes):
        rows = [("p", base + dt.timedelta(minutes=m), 50.0, 0.0, 0.0) for m in minutes]
        return spark.createDataFrame(
            rows, "project_id string, tick timestamp, error_rate double, cost_spike double, latency_p95 double"
        )

    root = str(tmp_path / "firings")
    parts = [(0, 5, 10), (15, 20), (), (25, 30, 40), (45, 50)]
    for n, part in enumerate(parts):
        jobs.cooldown_micro_batch(metrics(*part), n, alerts, root)
    jobs.cooldown_micro_batch(metrics(25, 30, 40), 3, alerts, root)  # run again
    fired = [r["tick"] for r in stored(spark, str(tmp_path), "firings").orderBy("tick").collect()]
    assert [int((t - base).total_seconds() // 60) for t in fired] == [0, 15, 30, 45]


def test_stream_traces_equal_batch_over_many_files(spark, tmp_path):
    rows = [
        (f"s{i}", f"t{i % 5}", None if i < 5 else "x", "p", f"n{i}", 1, None, 3, 0.25,
         "error" if i % 7 == 0 else "success", "{}", i) for i in range(60)
    ]
    schema = """span_id string, trace_id string, parent_span_id string, project_id string, name string,
        input_tokens int, output_tokens int, latency_ms int, cost_usd double, status string,
        metadata string, arrival_seq long"""
    spans = spark.createDataFrame(rows, schema).withColumns(
        {"started_at": F.timestamp_seconds("arrival_seq"), "ended_at": F.timestamp_seconds("arrival_seq")}
    )
    source = str(tmp_path / "spans")
    spans.repartition(6).write.parquet(source)
    stream = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 1).parquet(source)
    root = work_path(spark, "stream-test")
    jobs.stream_trace_rollup(stream, root, work_path(spark, "cp"), interval=None).awaitTermination()
    got = sorted(map(str, tables.read_traces(spark, root).collect()))
    assert got == sorted(map(str, trace_rollup(spans).collect()))


def test_intermediate_tables_can_be_dropped():
    import os
    import subprocess
    import sys

    # In a process of its own: other tests still read their tables.
    code = """
import glob, tempfile
from spanmill.session import build_session, drop_written, written
shared = tempfile.mkdtemp()
spark = build_session("local[1]", **{"spark.checkpoint.dir": shared, "spark.ui.showConsoleProgress": "false"})
assert written(spark.range(3), "kept").count() == 3 and glob.glob(shared + "/kept-*")
assert drop_written(spark) == 1 and not glob.glob(shared + "/kept-*") and drop_written(spark) == 0
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert work_path(spark, "x").startswith(shared_dir(spark))


def test_metrics_keep_one_state_row_per_project_and_window(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("pq"[i % 2], "error" if i % 5 == 0 else "success", None if i % 11 == 0 else i, 0.5, base + dt.timedelta(seconds=3 * i)) for i in range(800)]
    spans = spark.createDataFrame(rows, "project_id string, status string, latency_ms int, cost_usd double, started_at timestamp")
    source, out = str(tmp_path / "spans"), str(tmp_path / "out")
    spans.write.parquet(source)
    metrics = jobs.stream_alert_metrics(spark.readStream.schema(spans.schema).parquet(source))
    query = metrics.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out, format="parquet")
    query.awaitTermination()
    states = [p["stateOperators"] for p in query.recentProgress]
    # 40 minutes make 8 windows of two projects, whatever the number of distinct latencies.
    assert max(sum(s["numRowsTotal"] for s in ops) for ops in states) == 16
    closed = jobs.stream_alert_metrics(spans).filter(F.col("tick") <= base + dt.timedelta(minutes=25))
    got = sorted(map(str, spark.read.schema(metrics.schema).parquet(out).collect()))
    assert got == sorted(map(str, closed.collect())) and len(got) == 10
