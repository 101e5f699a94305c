"""Queries over alerts, retention, tiers and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import alerts, lifecycle
from spanmill.plans import derived as d
from spanmill.plans.registry import placed, query
from spanmill.session import work_path
from spanmill.sources import batches, tables
from spanmill.streaming import jobs

_AS_OF = f"TIMESTAMP '{d.AS_OF}'"
# A wide window, so that every project has spans at every scale.
MINUTES = 600
_WITHIN = f"started_at >= {_AS_OF} - INTERVAL {MINUTES} MINUTE AND started_at <= {_AS_OF}"
_METRICS = f"""SELECT project_id, count(*) FILTER (status = 'error') * 100e0 / count(*) AS error_rate,
    coalesce(sum(cost_usd), 0e0) AS cost_spike, coalesce(quantile_cont(latency_ms, 0.95), 0e0) AS latency_p95
  FROM spans WHERE {_WITHIN} GROUP BY project_id"""


@query(
    "alert_metrics",
    "spans",
    f"""SELECT project_id, round(error_rate, 9) AS error_rate, round(cost_spike, 9) AS cost_spike,
      round(latency_p95, 9) AS latency_p95 FROM ({_METRICS})""",
)
def _(spark, sf):
    return alerts.alert_metrics(d.spans(spark, sf), d.AS_OF, MINUTES)


@query(
    "alert_error_rate",
    "spans",
    f"""SELECT project_id, round(count(*) FILTER (status = 'error') * 100e0 / count(*), 9) AS value
    FROM spans WHERE {_WITHIN} GROUP BY project_id""",
)
def _(spark, sf):
    return alerts.alert_error_rate(d.spans(spark, sf), d.AS_OF, MINUTES)


@query(
    "alert_cost_spike",
    "spans",
    f"""SELECT project_id, round(coalesce(sum(cost_usd), 0e0), 9) AS value FROM spans WHERE {_WITHIN}
    GROUP BY project_id""",
)
def _(spark, sf):
    return alerts.alert_cost_spike(d.spans(spark, sf), d.AS_OF, MINUTES)


@query(
    "alert_latency_p95",
    "spans",
    f"""SELECT project_id, round(quantile_cont(latency_ms, 0.95), 9) AS value FROM spans
    WHERE {_WITHIN} AND latency_ms IS NOT NULL GROUP BY project_id""",
)
def _(spark, sf):
    return alerts.alert_latency_p95(d.spans(spark, sf), d.AS_OF, MINUTES)


@query(
    "alert_failure",
    "traces",
    f"""SELECT project_id, count(*) AS value FROM traces WHERE {_WITHIN} AND status = 'error'
    GROUP BY project_id""",
)
def _(spark, sf):
    return alerts.alert_failure(d.traces(spark, sf), d.AS_OF, MINUTES)


_VALUES = f"""m AS ({_METRICS}), vals AS (
    SELECT project_id, 'error_rate' AS type, error_rate AS value FROM m
    UNION ALL SELECT project_id, 'cost_spike', cost_spike FROM m
    UNION ALL SELECT project_id, 'latency_p95', latency_p95 FROM m
    UNION ALL SELECT project_id, 'failure', CAST(count(*) AS DOUBLE) FROM traces
      WHERE {_WITHIN} AND status = 'error' GROUP BY project_id)"""
# Recent firings: those of the orders, moved to just before the evaluation.
_RECENT = f"""recent AS (SELECT alert_id FROM (SELECT 'al-' || (o_orderkey % 37) AS alert_id,
    {_AS_OF} - (o_orderkey % 40) * INTERVAL 1 MINUTE AS fired_at FROM orders)
    WHERE fired_at > {_AS_OF} - INTERVAL 15 MINUTE AND alert_id NOT LIKE '%1')"""


def _recent(spark, sf):
    n = F.col("o_orderkey")
    as_of = F.lit(d.AS_OF).cast("timestamp")
    return (
        d.table(spark, sf, "orders")
        .select(
            F.concat(F.lit("al-"), (n % 37).cast("string")).alias("alert_id"),
            F.timestamp_seconds(F.unix_seconds(as_of) - n % 40 * 60).alias("fired_at"),
        )
        .filter("alert_id NOT LIKE '%1'")
    )


_EVALUATED = f"""WITH {_VALUES}, {_RECENT}, fired AS (
    SELECT a.*, v.value FROM alerts a JOIN vals v USING (project_id, type)
    WHERE a.is_active AND v.value > a.threshold AND a.alert_id NOT IN (SELECT alert_id FROM recent))"""


@query(
    "evaluate_alerts",
    "traces alerts",
    f"""{_EVALUATED} SELECT alert_id, project_id, name AS alert_name, type AS alert_type,
      round(value, 9) AS current_value, CAST(threshold AS DOUBLE) AS threshold, channel,
      'pending' AS delivery_status, {_AS_OF} AS fired_at FROM fired""",
)
def _(spark, sf):
    fired = alerts.evaluate_alerts(
        d.alerts(spark, sf), d.spans(spark, sf), d.traces(spark, sf), _recent(spark, sf), d.AS_OF, MINUTES
    )
    return fired.drop("error_message")


@query(
    "alert_payload",
    "traces alerts projects",
    f"""{_EVALUATED} SELECT alert_id, p.name AS project_name,
      'https://dash.example.com/projects/' || project_id || '/alerts' AS dashboard_url,
      CASE channel WHEN 'slack' THEN 'blocks' WHEN 'email' THEN 'Alert fired: ' || fired.name
        ELSE 'alert.fired' END AS head
    FROM fired LEFT JOIN projects p USING (project_id)""",
)
def _(spark, sf):
    fired = alerts.evaluate_alerts(
        d.alerts(spark, sf), d.spans(spark, sf), d.traces(spark, sf), _recent(spark, sf), d.AS_OF, MINUTES
    )
    outbox = alerts.alert_payload(fired, d.projects(spark), "https://dash.example.com")
    # Whole bodies are compared with fixed texts in the tests.
    head = (
        F.when(F.get_json_object("body", "$.blocks[2].elements[0].url") == F.col("dashboard_url"), "blocks")
        .when(F.col("channel") == "email", F.get_json_object("body", "$.subject"))
        .otherwise(F.get_json_object("body", "$.event"))
    )
    return outbox.select("alert_id", "project_name", "dashboard_url", head.alias("head"))


@query(
    "test_alert_payload",
    "alerts",
    """SELECT alert_id, '[TEST] ' || name AS alert_name, 0e0 AS current_value, 'Test Project' AS project_name,
      channel FROM alerts""",
)
def _(spark, sf):
    rows = alerts.test_alert_payload(d.alerts(spark, sf), "https://dash.example.com", d.AS_OF)
    return rows.select("alert_id", "alert_name", "current_value", "project_name", "channel")


def _ticks(both_ends: bool) -> str:
    """Spans with their five-minute ticks."""
    end = "time_bucket(INTERVAL 5 MINUTE, started_at) + INTERVAL 5 MINUTE"
    edge = "UNION ALL SELECT *, started_at AS tick FROM {0} WHERE time_bucket(INTERVAL 5 MINUTE, started_at) = started_at"
    return f"""ts AS (SELECT *, {end} AS tick FROM spans {edge.format('spans') if both_ends else ''}),
    tt AS (SELECT *, {end} AS tick FROM traces {edge.format('traces') if both_ends else ''})"""


_TICK_VALUES = """tm AS (SELECT project_id, tick, count(*) FILTER (status = 'error') * 100e0 / count(*) AS error_rate,
      coalesce(sum(cost_usd), 0e0) AS cost_spike, coalesce(quantile_cont(latency_ms, 0.95), 0e0) AS latency_p95
    FROM ts GROUP BY 1, 2),
    tv AS (SELECT project_id, tick, 'error_rate' AS type, error_rate AS value FROM tm
      UNION ALL SELECT project_id, tick, 'cost_spike', cost_spike FROM tm
      UNION ALL SELECT project_id, tick, 'latency_p95', latency_p95 FROM tm)"""
_FOLD = """fold AS (
      SELECT alert_id, min(tick) AS tick FROM breaches GROUP BY alert_id
      UNION ALL
      SELECT f.alert_id, (SELECT min(b.tick) FROM breaches b WHERE b.alert_id = f.alert_id
        AND b.tick >= f.tick + INTERVAL 15 MINUTE) AS tick
      FROM fold f WHERE f.tick IS NOT NULL)"""


@query(
    "replay_alerts",
    "traces alerts",
    f"""WITH RECURSIVE {_ticks(True)}, {_TICK_VALUES},
    allv AS (SELECT * FROM tv UNION ALL SELECT project_id, tick, 'failure', CAST(count(*) AS DOUBLE)
      FROM tt WHERE status = 'error' GROUP BY 1, 2),
    breaches AS (SELECT a.alert_id, a.project_id, a.type, v.tick, v.value, a.threshold
      FROM alerts a JOIN allv v USING (project_id, type) WHERE a.is_active AND v.value > a.threshold),
    {_FOLD}
    SELECT b.alert_id, b.project_id, b.type, b.tick, round(b.value, 9) AS value,
      CAST(b.threshold AS DOUBLE) AS threshold
    FROM fold f JOIN breaches b ON b.alert_id = f.alert_id AND b.tick = f.tick""",
)
def _(spark, sf):
    return alerts.replay_alerts(d.alerts(spark, sf), d.spans(spark, sf), d.traces(spark, sf))


@query(
    "alert_history",
    "firings",
    """SELECT firing_id, alert_id, round(current_value, 9) AS current_value, fired_at FROM firings
    WHERE project_id = 'p1' ORDER BY fired_at DESC, firing_id LIMIT 100 OFFSET 20""",
)
def _(spark, sf):
    rows = alerts.alert_history(d.firings(spark, sf), "p1", limit=100, offset=20)
    return rows.drop("project_id")


@query(
    "alerts_list",
    "alerts",
    """SELECT alert_id, project_id, name, type, created_at,
      CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, alert_id) AS INTEGER) AS place
    FROM alerts""",
)
def _(spark, sf):
    rows = placed(alerts.alerts_list(d.alerts(spark, sf)), "project_id")
    return rows.select("alert_id", "project_id", "name", "type", "created_at", "place")


_KEPT = f"p.retention_days IS NULL OR started_at >= {_AS_OF} - p.retention_days * INTERVAL 1 DAY"


@query(
    "retention_report",
    "spans projects",
    f"""SELECT p.project_id, p.retention_days, count(s.span_id) AS deleted FROM projects p
    LEFT JOIN spans s ON s.project_id = p.project_id
      AND s.started_at < {_AS_OF} - p.retention_days * INTERVAL 1 DAY
    WHERE p.retention_days IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    return lifecycle.retention_report(d.spans(spark, sf), d.projects(spark), d.AS_OF)


@query(
    "retained_spans",
    "spans projects",
    f"SELECT span_id FROM spans LEFT JOIN projects p USING (project_id) WHERE {_KEPT}",
)
def _(spark, sf):
    return lifecycle.retained(d.spans(spark, sf), d.projects(spark), d.AS_OF).select("span_id")


@query(
    "retention_cleanup_counts",
    "spans projects",
    f"""SELECT p.project_id, count(s.span_id) AS deleted, 'ok' AS outcome FROM projects p
    LEFT JOIN spans s ON s.project_id = p.project_id
      AND s.started_at < {_AS_OF} - p.retention_days * INTERVAL 1 DAY
    WHERE p.retention_days IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    path = work_path(spark, "retention")
    batches.spans_sink(d.spans(spark, sf), path)
    return lifecycle.retention_cleanup(spark, path, d.projects(spark), d.AS_OF)


@query(
    "retention_cleanup",
    "spans projects",
    f"SELECT span_id, project_id FROM spans LEFT JOIN projects p USING (project_id) WHERE {_KEPT}",
)
def _(spark, sf):
    path = work_path(spark, "retention")
    batches.spans_sink(d.spans(spark, sf), path)
    lifecycle.retention_cleanup(spark, path, d.projects(spark), d.AS_OF)
    return batches.read_spans(spark, path).select("span_id", "project_id")


# Tiers as seen 95 days after the start, so that all four occur.
_LATER = "TIMESTAMP '2024-04-05 00:00:00'"


@query(
    "lifecycle_tier",
    "spans",
    f"""SELECT span_id, CAST(floor(age) AS INT) AS age_days, CASE WHEN age >= 90 THEN 'delete'
      WHEN age >= 60 THEN 'cold' WHEN age >= 30 THEN 'warm' ELSE 'hot' END AS tier,
      CASE WHEN age < 30 THEN CAST(floor(age / 7) AS INT) END AS generation
    FROM (SELECT span_id, (epoch_us({_LATER}) - epoch_us(started_at)) / 86400000000e0 AS age
      FROM (SELECT span_id, started_at + (arrival_seq % 2) * INTERVAL 60 DAY AS started_at FROM spans))""",
)
def _(spark, sf):
    moved = d.spans(spark, sf).withColumn(
        "started_at",
        F.timestamp_micros(F.unix_micros("started_at") + F.col("arrival_seq") % 2 * 60 * 86_400_000_000),
    )
    rows = lifecycle.lifecycle_tier(moved, "2024-04-05 00:00:00")
    return rows.select("span_id", "age_days", "tier", "generation")


@query(
    "tier_report",
    "spans",
    f"""SELECT project_id, CASE WHEN age >= 90 THEN 'delete' WHEN age >= 60 THEN 'cold'
        WHEN age >= 30 THEN 'warm' ELSE 'hot' END AS tier, count(*) AS spans, min(started_at) AS oldest
    FROM (SELECT *, (epoch_us({_LATER}) - epoch_us(started_at)) / 86400000000e0 AS age FROM spans)
    GROUP BY 1, 2""",
)
def _(spark, sf):
    return lifecycle.tier_report(d.spans(spark, sf), "2024-04-05 00:00:00")


# --- Streaming jobs, drained over the events table as their source ---


def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # A glob, because a file source wants a folder or a pattern.
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


def _span_stream(spark, sf):
    return jobs.compute_cost(d.events_as_spans(_event_stream(spark, sf)))


def _drained(spark, df, name):
    out = work_path(spark, name)
    jobs.drain(df, out, work_path(spark, f"{name}-checkpoint"))
    return spark.read.schema(df.schema).parquet(out)


@query(
    "stream_ingest",
    "wire spans",
    """SELECT w.span_id, w.trace_id, w.project_id, CASE WHEN s.agent_name IS NULL AND w.parent_span_id IS NULL
        THEN w.name WHEN s.agent_name IS NULL THEN r.name ELSE s.agent_name END AS agent_name,
      round(s.cost_usd, 9) AS cost_usd, w.status, w.started_at
    FROM wire w JOIN spans s USING (span_id)
    LEFT JOIN (SELECT trace_id, name FROM wire WHERE parent_span_id IS NULL AND reasons = '') r
      ON r.trace_id = w.trace_id
    WHERE w.reasons = ''""",
)
def _(spark, sf):
    source = work_path(spark, "envelopes")
    batches.write_envelopes(d.raw_envelopes(spark, sf), source)
    root = work_path(spark, "ingest")
    raw = batches.read_span_batches(spark, source, streaming=True)
    jobs.stream_ingest(raw, root, work_path(spark, "checkpoint"), interval=None).awaitTermination()
    stored = spark.read.option("basePath", f"{root}/spans").parquet(f"{root}/spans")
    return stored.select(
        "span_id", "trace_id", "project_id", "agent_name", "cost_usd", "status", "started_at"
    )


@query("stream_dedup", "raw_spans", "SELECT span_id, trace_id, status FROM raw_spans")
def _(spark, sf):
    # Every 31st event arrives twice.
    events = _event_stream(spark, sf)
    twice = events.withColumn("_copy", F.explode(F.expr("sequence(1, IF(event_id % 31 = 0, 2, 1))")))
    deduped = jobs.stream_dedup(d.events_as_spans(twice))
    return _drained(spark, deduped.select("span_id", "trace_id", "status"), "dedup")


@query(
    "stream_trace_rollup",
    "traces",
    """SELECT trace_id, project_id, session_id, agent_name, status, total_spans, total_tokens,
      round(total_cost_usd, 9) AS total_cost_usd, total_latency_ms, started_at, ended_at
    FROM traces""",
)
def _(spark, sf):
    root = work_path(spark, "stream-traces")
    stream = jobs.stream_trace_rollup(
        _span_stream(spark, sf), root, work_path(spark, "checkpoint"), interval=None
    )
    stream.awaitTermination()
    return tables.read_traces(spark, root).drop("metadata")


_FEED = """SELECT project_id, span_id, agent_name, model, status, started_at FROM spans {0}
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY arrival_seq DESC, span_id DESC) <= 200"""


@query("stream_live_feed", "spans", _FEED.format("WHERE status = 'error' AND model = 'gpt-4o'"))
def _(spark, sf):
    feed = jobs.stream_live_feed(_span_stream(spark, sf), errors_only=True, model="gpt-4o")
    rows = jobs.latest_feed(_drained(spark, feed, "feed"))
    return rows.select("project_id", "span_id", "agent_name", "model", "status", "started_at")


@query("live_feed_by_agent", "spans", _FEED.format("WHERE agent_name = 'planner'"))
def _(spark, sf):
    feed = jobs.live_feed_by_agent(_span_stream(spark, sf), "planner")
    rows = jobs.latest_feed(_drained(spark, feed, "agent-feed"))
    return rows.select("project_id", "span_id", "agent_name", "model", "status", "started_at")


@query("stream_trace_feed", "spans", "SELECT span_id, name, status FROM spans WHERE trace_id = 'tr-400'")
def _(spark, sf):
    feed = jobs.stream_trace_feed(_span_stream(spark, sf), "tr-400").select("span_id", "name", "status")
    return _drained(spark, feed, "trace-feed")


# A stream emits a window once the watermark (latest start minus ten minutes) has passed it.
_CLOSED = "<= (SELECT max(started_at) FROM spans) - INTERVAL 10 MINUTE"


@query(
    "stream_throughput",
    "spans",
    f"""SELECT project_id, window_start, count(*) AS calls, round(count(*) / 5, 9) AS calls_per_sec
    FROM (SELECT project_id, time_bucket(INTERVAL 5 SECOND, started_at) AS window_start FROM spans)
    WHERE window_start + INTERVAL 5 SECOND {_CLOSED} GROUP BY 1, 2""",
)
def _(spark, sf):
    return _drained(spark, jobs.stream_throughput(_span_stream(spark, sf)), "throughput")


@query("known_models", "spans", "SELECT DISTINCT model FROM spans WHERE model IS NOT NULL")
def _(spark, sf):
    return _drained(spark, jobs.known_models(_span_stream(spark, sf)), "models")


@query(
    "stream_alert_metrics",
    "traces",
    f"""WITH {_ticks(False)}, {_TICK_VALUES}
    SELECT project_id, tick, round(error_rate, 9) AS error_rate, round(cost_spike, 9) AS cost_spike,
      round(latency_p95, 9) AS latency_p95 FROM tm WHERE tick {_CLOSED}""",
)
def _(spark, sf):
    return _drained(spark, jobs.stream_alert_metrics(_span_stream(spark, sf)), "alert-metrics")


@query(
    "stream_alert_cooldown",
    "traces alerts",
    f"""WITH RECURSIVE {_ticks(False)}, {_TICK_VALUES},
    allv AS (SELECT * FROM tv UNION ALL SELECT project_id, tick, 'failure', CAST(count(*) AS DOUBLE)
      FROM tt SEMI JOIN tm USING (project_id, tick) WHERE status = 'error' GROUP BY 1, 2),
    breaches AS (SELECT a.alert_id, a.project_id, a.type, v.tick, v.value, a.threshold
      FROM alerts a JOIN allv v USING (project_id, type)
      WHERE a.is_active AND v.value > a.threshold AND v.tick {_CLOSED}),
    {_FOLD}
    SELECT b.alert_id, b.project_id, b.type, b.tick, round(b.value, 9) AS value,
      CAST(b.threshold AS DOUBLE) AS threshold
    FROM fold f JOIN breaches b ON b.alert_id = f.alert_id AND b.tick = f.tick""",
)
def _(spark, sf):
    root = work_path(spark, "stream-firings")
    traces_root = work_path(spark, "alert-traces")
    tables.write_trace_partials(d.spans(spark, sf), traces_root, 0)
    metrics = jobs.stream_alert_metrics(_span_stream(spark, sf))
    stream = jobs.stream_alert_cooldown(
        metrics, d.alerts(spark, sf), root, work_path(spark, "checkpoint"), interval=None, traces_root=traces_root
    )
    stream.awaitTermination()
    return spark.read.option("basePath", root).parquet(root).drop("ingest_batch", "date")
