"""Queries over roll-ups, overview, cost and trace reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import cost, errors, overview, rollup, sketches, traces
from spanmill.plans import derived as d
from spanmill.plans.registry import placed, query
from spanmill.session import work_path

RANGE = (None, d.START, d.END)
PERIOD = (None, "2024-01-16 00:00:00", "2024-01-30 00:00:00")
_IN = f"started_at >= TIMESTAMP '{d.START}' AND started_at <= TIMESTAMP '{d.END}'"
_IN_PERIOD = f"started_at >= TIMESTAMP '{PERIOD[1]}' AND started_at <= TIMESTAMP '{PERIOD[2]}'"
_AS_OF = f"TIMESTAMP '{d.AS_OF}'"

_TRACE = """trace_id, project_id, session_id, agent_name, status, total_spans, total_tokens,
  round(total_cost_usd, 9) AS total_cost_usd, total_latency_ms, started_at, ended_at, metadata"""


@query("trace_rollup", "traces", f"SELECT {_TRACE} FROM traces")
def _(spark, sf):
    return rollup.trace_rollup(d.duplicates(spark, sf))


@query(
    "trace_rollup_dup_counting",
    "delivered",
    """SELECT trace_id, arg_min(project_id, arrival_seq) AS project_id, count(*) AS total_spans,
      CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS total_tokens,
      round(sum(coalesce(cost_usd, 0e0)), 9) AS total_cost_usd,
      CAST(sum(coalesce(latency_ms, 0)) AS BIGINT) AS total_latency_ms,
      arg_max(ended_at, arrival_seq) FILTER (ended_at IS NOT NULL) AS ended_at
    FROM delivered GROUP BY trace_id""",
)
def _(spark, sf):
    rolled = rollup.trace_rollup(d.duplicates(spark, sf), count_duplicates=True)
    return rolled.select(
        "trace_id", "project_id", "total_spans", "total_tokens", "total_cost_usd", "total_latency_ms", "ended_at"
    )


@query(
    "trace_rollup_eventtime",
    "spans",
    """SELECT trace_id, min(project_id) AS project_id,
      arg_min(name, started_at) FILTER (parent_span_id IS NULL) AS agent_name,
      CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'timeout') THEN 'timeout'
        ELSE 'success' END AS status, count(*) AS total_spans,
      CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS total_tokens,
      round(sum(coalesce(cost_usd, 0e0)), 9) AS total_cost_usd,
      CAST(sum(coalesce(latency_ms, 0)) AS BIGINT) AS total_latency_ms,
      min(started_at) AS started_at, max(ended_at) AS ended_at
    FROM spans GROUP BY trace_id""",
)
def _(spark, sf):
    return rollup.trace_rollup_eventtime(d.spans(spark, sf))


@query(
    "session_rollup",
    "traces",
    """SELECT session_id, count(*) AS traces, CAST(sum(total_spans) AS BIGINT) AS spans,
      round(sum(total_cost_usd), 9) AS cost_usd, min(started_at) AS first_at, max(started_at) AS last_at,
      arg_min(trace_id, (started_at, trace_id)) AS first_trace_id,
      arg_max(trace_id, (started_at, trace_id)) AS last_trace_id
    FROM traces WHERE session_id IS NOT NULL GROUP BY session_id""",
)
def _(spark, sf):
    return rollup.session_rollup(d.traces(spark, sf))


@query(
    "session_traces",
    "traces",
    "SELECT session_id, trace_id, started_at, status FROM traces WHERE session_id IS NOT NULL",
)
def _(spark, sf):
    rows = rollup.session_traces(d.traces(spark, sf))
    return rows.select("session_id", "trace_id", "started_at", "status")


@query(
    "trace_total_tokens",
    "traces",
    "SELECT trace_id, total_tokens FROM traces",
)
def _(spark, sf):
    return rollup.trace_total_tokens(d.spans(spark, sf))


_SUMMARY = """count(*) AS total_spans, count(*) FILTER (status = 'error') AS error_count,
  round(coalesce(sum(cost_usd), 0e0), 9) AS total_cost_usd,
  round(coalesce(avg(latency_ms), 0e0), 9) AS avg_latency_ms,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,
  count(DISTINCT trace_id) AS unique_traces,
  round(coalesce(quantile_cont(latency_ms, 0.95), 0e0), 9) AS p95_latency_ms"""


@query(
    "summary_stats", "spans", f"SELECT project_id, {_SUMMARY} FROM spans WHERE {_IN} GROUP BY project_id"
)
def _(spark, sf):
    return overview.summary_stats(d.spans(spark, sf), *RANGE)


@query(
    "summary_stats_project",
    "spans",
    f"SELECT {_SUMMARY} FROM spans WHERE project_id = 'p1' AND {_IN_PERIOD}",
)
def _(spark, sf):
    return overview.summary_stats(d.spans(spark, sf), "p1", *PERIOD[1:])


@query("summary_stats_empty", "spans", f"SELECT {_SUMMARY} FROM spans WHERE project_id = 'p9'")
def _(spark, sf):
    return overview.summary_stats(d.spans(spark, sf), "p9")


def _sketches(spark, sf):
    """Sketches of the spans, stored in two batches that share hours."""
    root, spans = work_path(spark, "sketches"), d.spans(spark, sf)
    for batch in (0, 1):
        sketches.write_sketches(spans.filter(F.col("arrival_seq") % 2 == batch), root, batch)
    return sketches.read_sketches(spark, root)


# Approximate results have no exact SQL twin; summary_sketch_errors checks their bounds.
@query("summary_stats_approx")
def _(spark, sf):
    return sketches.sketched_summary(_sketches(spark, sf), None, *RANGE)


_IN_HOURS = f"started_at >= TIMESTAMP '{d.START}' AND started_at < TIMESTAMP '{d.END}'"


@query(
    "summary_sketch_errors",
    "spans",
    f"""SELECT project_id, count(*) AS total_spans, count(*) FILTER (status = 'error') AS error_count,
      round(coalesce(sum(cost_usd), 0e0), 9) AS total_cost_usd,
      round(coalesce(avg(latency_ms), 0e0), 9) AS avg_latency_ms,
      CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
      CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,
      true AS p95_within, true AS traces_within
    FROM spans WHERE {_IN_HOURS} GROUP BY project_id""",
)
def _(spark, sf):
    found = sketches.sketch_errors(_sketches(spark, sf), d.spans(spark, sf), *RANGE)
    return found.select(
        "project_id", "total_spans", "error_count", "total_cost_usd", "avg_latency_ms", "total_input_tokens",
        "total_output_tokens", (F.col("rank_error") <= 2 * sketches.RANK_ERROR).alias("p95_within"),
        (F.col("traces_error") <= 2 * sketches.TRACES_ERROR).alias("traces_within"),
    )


@query(
    "usage_by_model_sketched",
    "spans",
    f"""SELECT project_id, model, count(*) AS total_spans, count(*) FILTER (status = 'error') AS error_count,
      round(coalesce(sum(cost_usd), 0e0), 9) AS total_cost_usd
    FROM spans WHERE started_at >= TIMESTAMP '2024-01-05 06:00:00' AND started_at < TIMESTAMP '2024-01-19 17:00:00'
    GROUP BY project_id, model""",
)
def _(spark, sf):
    rows = sketches.sketched_summary(
        _sketches(spark, sf), ["project_id", "model"], None, "2024-01-05 06:00:00", "2024-01-19 17:00:00"
    )
    return rows.select("project_id", "model", "total_spans", "error_count", "total_cost_usd")


@query(
    "summary_by_trace",
    "traces",
    f"""SELECT project_id, count(*) AS unique_traces, count(*) FILTER (status = 'error') AS error_count,
      round(coalesce(sum(total_cost_usd), 0e0), 9) AS total_cost_usd,
      round(coalesce(avg(total_latency_ms), 0e0), 9) AS avg_latency_ms,
      round(coalesce(quantile_cont(total_latency_ms, 0.95), 0e0), 9) AS p95_latency_ms
    FROM traces WHERE {_IN} GROUP BY project_id""",
)
def _(spark, sf):
    return overview.summary_by_trace(d.traces(spark, sf), *RANGE)


def _two_windows(hours: int, table: str, what: str, edge: str) -> str:
    mid = f"{_AS_OF} - INTERVAL {hours} HOUR"
    far = f"{_AS_OF} - INTERVAL {2 * hours} HOUR"
    now = f"started_at >= {mid} AND started_at <= {_AS_OF}"
    before = f"started_at >= {far} AND started_at {edge} {mid}"
    return f"""SELECT project_id, count({what}) FILTER ({now}) AS total_requests,
      count(*) FILTER ({now} AND status = 'error') AS error_count,
      count({what}) FILTER ({before}) AS total_requests_prev,
      count(*) FILTER ({before} AND status = 'error') AS error_count_prev
    FROM {table} WHERE started_at >= {far} AND started_at <= {_AS_OF} GROUP BY project_id"""


@query("prev_window_summary", "spans", _two_windows(168, "spans", "DISTINCT trace_id", "<="))
def _(spark, sf):
    return overview.prev_window_summary(d.spans(spark, sf), None, d.AS_OF, 168)


@query("prev_window_by_trace", "traces", _two_windows(168, "traces", "*", "<"))
def _(spark, sf):
    return overview.prev_window_by_trace(d.traces(spark, sf), None, d.AS_OF, 168)


@query(
    "month_to_date_cost",
    "spans",
    f"""SELECT project_id, round(coalesce(sum(cost_usd), 0e0), 9) AS month_cost_usd FROM spans
    WHERE started_at >= date_trunc('month', {_AS_OF}) AND started_at <= {_AS_OF} GROUP BY project_id""",
)
def _(spark, sf):
    return overview.month_to_date_cost(d.spans(spark, sf), None, d.AS_OF)


def _filled(step: str, bucket: str, cast: str, sums: str, outs: str) -> str:
    return f"""WITH b AS (SELECT project_id, {bucket} AS k, {sums} FROM spans WHERE {_IN}
      GROUP BY project_id, {bucket}),
    grid AS (SELECT project_id, CAST(unnest(generate_series(CAST(min(k) AS TIMESTAMP),
      CAST(max(k) AS TIMESTAMP), INTERVAL 1 {step})) AS {cast}) AS k FROM b GROUP BY project_id)
    SELECT grid.project_id, grid.k AS {outs} FROM grid
    LEFT JOIN b ON b.project_id = grid.project_id AND b.k = grid.k"""


@query(
    "hourly_volume",
    "spans",
    _filled(
        "HOUR",
        "date_trunc('hour', started_at)",
        "TIMESTAMP",
        "count(*) AS total, count(*) FILTER (status = 'error') AS errors",
        "hour, coalesce(b.total, 0) AS total, coalesce(b.errors, 0) AS errors",
    ),
)
def _(spark, sf):
    return overview.hourly_volume(d.spans(spark, sf), *RANGE)


@query(
    "hourly_volume_by_trace",
    "traces",
    f"""SELECT project_id, date_trunc('hour', started_at) AS hour, count(*) AS total,
      count(*) FILTER (status = 'error') AS errors FROM traces WHERE {_IN} GROUP BY 1, 2""",
)
def _(spark, sf):
    return overview.hourly_volume_by_trace(d.traces(spark, sf), *RANGE)


@query(
    "volume_by_grain",
    "spans",
    f"""SELECT project_id, time_bucket(INTERVAL 7 DAY, started_at, TIMESTAMP '1970-01-01') AS bucket,
      count(*) AS total, count(*) FILTER (status = 'error') AS errors
    FROM spans WHERE {_IN} GROUP BY 1, 2""",
)
def _(spark, sf):
    return overview.volume_by_grain(d.spans(spark, sf), "7d", *RANGE)


_USAGE = f"""usage AS (
  SELECT project_id, model, coalesce(arg_min(provider, (-pn, provider)) FILTER (provider IS NOT NULL), 'unknown') AS provider,
    CAST(sum(pn) AS BIGINT) AS calls, coalesce(sum(c), 0e0) AS cost_usd,
    coalesce(sum(i) / sum(i_n), 0e0) + coalesce(sum(o) / sum(o_n), 0e0) AS avg_tokens_per_call,
    coalesce(sum(c), 0e0) / sum(pn) AS avg_cost_per_call, coalesce(sum(l) / sum(l_n), 0e0) AS avg_latency_ms
  FROM (SELECT project_id, model, provider, count(*) AS pn, sum(cost_usd) AS c,
      CAST(sum(input_tokens) AS DOUBLE) AS i, count(input_tokens) AS i_n,
      CAST(sum(output_tokens) AS DOUBLE) AS o, count(output_tokens) AS o_n,
      CAST(sum(latency_ms) AS DOUBLE) AS l, count(latency_ms) AS l_n
    FROM spans WHERE {_IN} AND model IS NOT NULL GROUP BY 1, 2, 3)
  GROUP BY project_id, model)"""


@query(
    "model_usage",
    "spans",
    f"""WITH {_USAGE} SELECT project_id, model, provider, calls, round(cost_usd, 9) AS cost_usd,
      round(avg_tokens_per_call, 9) AS avg_tokens_per_call, round(avg_cost_per_call, 9) AS avg_cost_per_call,
      round(avg_latency_ms, 9) AS avg_latency_ms FROM usage
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY calls DESC, model) <= 50""",
)
def _(spark, sf):
    return overview.model_usage(d.spans(spark, sf), *RANGE)


@query(
    "model_usage_pg",
    "spans",
    f"""SELECT project_id, model, count(*) AS calls, round(coalesce(sum(cost_usd), 0e0), 9) AS cost_usd
    FROM spans WHERE {_IN} AND model IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    return overview.model_usage_pg(d.spans(spark, sf), *RANGE)


@query(
    "model_share",
    "spans",
    f"""WITH {_USAGE} SELECT project_id, model, calls,
      round(calls * 100e0 / max(calls) OVER (PARTITION BY project_id), 9) AS share_pct FROM usage""",
)
def _(spark, sf):
    usage = overview.model_usage(d.spans(spark, sf), *RANGE, limit=None)
    shares = overview.model_share(usage, ["project_id"])
    return shares.select("project_id", "model", "calls", "share_pct")


@query(
    "top_agents",
    "spans",
    f"""SELECT project_id, agent_name, count(DISTINCT trace_id) AS trace_count,
      count(DISTINCT trace_id) FILTER (status = 'error') AS error_count,
      round(coalesce(avg(latency_ms), 0e0), 9) AS avg_latency_ms,
      round(coalesce(sum(cost_usd), 0e0), 9) AS cost_usd
    FROM spans WHERE {_IN} AND agent_name IS NOT NULL GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, agent_name) <= 5""",
)
def _(spark, sf):
    return overview.top_agents(d.spans(spark, sf), *RANGE)


@query(
    "top_agents_by_trace",
    "traces",
    f"""SELECT project_id, coalesce(agent_name, 'unknown') AS agent_name, count(*) AS calls,
      count(*) FILTER (status = 'error') AS errors,
      CAST(floor(avg(total_latency_ms) + 0.5) AS BIGINT) AS avg_latency_ms,
      round(coalesce(sum(total_cost_usd), 0e0), 9) AS cost_usd
    FROM traces WHERE {_IN} GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, 2) <= 5""",
)
def _(spark, sf):
    return overview.top_agents_by_trace(d.traces(spark, sf), *RANGE)


_ERRORS = f"""SELECT project_id, trace_id, span_id, coalesce(nullif(error_message, ''), 'Unknown error') AS error_message,
    agent_name, model, started_at FROM spans WHERE status = 'error' AND {_IN}
  QUALIFY row_number() OVER (PARTITION BY project_id, trace_id ORDER BY started_at DESC, span_id) = 1"""


@query(
    "recent_errors",
    "spans",
    f"""WITH e AS ({_ERRORS}) SELECT * EXCLUDE (span_id) FROM e
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, span_id) <= 5""",
)
def _(spark, sf):
    return overview.recent_errors(d.spans(spark, sf), *RANGE)


@query(
    "recent_errors_by_trace",
    "traces",
    f"""WITH top AS (SELECT * FROM traces WHERE status = 'error' AND {_IN}
      QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, trace_id) <= 5)
    SELECT t.project_id, t.trace_id, coalesce(s.error_message, 'Unknown error') AS error_message,
      t.agent_name, s.model, t.started_at
    FROM top t LEFT JOIN LATERAL (SELECT error_message, model FROM spans
      WHERE spans.trace_id = t.trace_id AND spans.status = 'error'
      ORDER BY spans.started_at DESC, span_id LIMIT 1) s ON true""",
)
def _(spark, sf):
    return overview.recent_errors_by_trace(d.traces(spark, sf), d.spans(spark, sf), *RANGE)


@query(
    "active_traces",
    "traces",
    """SELECT project_id, count(*) FILTER (status = 'running') AS active_traces FROM traces
    GROUP BY project_id""",
)
def _(spark, sf):
    return overview.active_traces(d.traces(spark, sf))


def _clusters(pattern: str) -> str:
    return f"""WITH e AS (SELECT project_id, {pattern} AS pattern, span_id, trace_id, model, started_at
      FROM spans WHERE status = 'error' AND error_message IS NOT NULL AND {_IN}),
    top AS (SELECT project_id, pattern, count(*) AS span_count, count(DISTINCT trace_id) AS count,
        max(started_at) AS last_seen FROM e GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, pattern) <= 10),
    s AS (SELECT project_id, pattern, string_agg(trace_id, ',' ORDER BY started_at DESC, span_id) AS trace_ids
      FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY project_id, pattern
        ORDER BY started_at DESC, span_id) <= 3) GROUP BY 1, 2),
    m AS (SELECT project_id, pattern, string_agg(model, ',' ORDER BY n DESC, model) AS models
      FROM (SELECT project_id, pattern, model, count(*) AS n FROM e WHERE model IS NOT NULL GROUP BY 1, 2, 3
        QUALIFY row_number() OVER (PARTITION BY project_id, pattern ORDER BY count(*) DESC, model) <= 5)
      GROUP BY 1, 2)
    SELECT top.*, s.trace_ids, coalesce(m.models, '') AS models FROM top JOIN s USING (project_id, pattern)
    LEFT JOIN m USING (project_id, pattern)"""


@query("error_clusters", "spans", _clusters("error_message"))
def _(spark, sf):
    return errors.error_clusters(d.spans(spark, sf), *RANGE)


@query(
    "error_clusters_normalized",
    "spans",
    _clusters(r"regexp_replace(error_message, '\d+', '<num>', 'g')"),
)
def _(spark, sf):
    return errors.error_clusters_normalized(d.spans(spark, sf), *RANGE)


def _failing(spans):
    """Messages that differ in a file, or in a file and a host, or in nothing."""
    k = F.col("arrival_seq")
    file = F.concat(F.lit("/data/"), F.char(97 + k % 26), F.char(97 + F.floor(k / 26) % 26), F.lit(".json"))
    host = F.concat(F.lit("db-"), F.char(97 + k % 5), F.lit(".local"))
    message = F.when(k % 3 == 0, F.concat(F.lit("cannot open "), file, F.lit(" for reading")))
    message = message.when(k % 3 == 1, F.concat(F.lit("upload of "), file, F.lit(" to "), host, F.lit(" failed"))).otherwise("quota exceeded")
    return spans.withColumn("error_message", F.when(F.col("error_message").isNotNull(), message))


@query(
    "error_clusters_similar",
    "spans",
    _clusters("""CASE arrival_seq % 3 WHEN 0 THEN 'cannot open <*> for reading'
      WHEN 1 THEN 'upload of <*> to <*> failed' ELSE 'quota exceeded' END"""),
)
def _(spark, sf):
    return errors.error_clusters_similar(_failing(d.spans(spark, sf)), *RANGE)


@query(
    "error_significant_terms",
    "text_spans",
    r"""WITH docs AS (SELECT project_id, status = 'error' AS failed,
        list_distinct(regexp_extract_all(lower(input), '[\p{L}\p{N}_]+')) AS words FROM text_spans),
    n AS (SELECT project_id, count(*) AS bg_size, count(*) FILTER (failed) AS fg_size FROM docs GROUP BY 1),
    t AS (SELECT project_id, term, count(*) AS bg_count, count(*) FILTER (failed) AS fg_count
      FROM (SELECT project_id, failed, unnest(words) AS term FROM docs) GROUP BY 1, 2),
    scored AS (SELECT t.*, n.fg_size, n.bg_size, (fg_count / fg_size - bg_count / bg_size)
        * ((fg_count / fg_size) / (bg_count / bg_size)) AS score
      FROM t JOIN n USING (project_id) WHERE fg_count > 0)
    SELECT project_id, term, fg_count, fg_size, bg_count, bg_size, round(score, 9) AS score FROM scored
    WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY round(score, 9) DESC, term) <= 10""",
)
def _(spark, sf):
    return errors.error_significant_terms(d.text_spans(spark, sf), "input")


_PAIR = _two_windows(168, "spans", "DISTINCT trace_id", "<=")


@query(
    "overview_deltas",
    "spans",
    f"""SELECT *, round((total_requests - total_requests_prev) * 100e0 / nullif(total_requests_prev, 0), 9)
        AS request_delta_pct,
      round(coalesce(error_count * 100e0 / nullif(total_requests, 0), 0), 9) AS error_rate_pct,
      round((error_count - error_count_prev) * 100e0 / nullif(error_count_prev, 0), 9) AS error_delta_pct
    FROM ({_PAIR})""",
)
def _(spark, sf):
    return overview.overview_deltas(overview.prev_window_summary(d.spans(spark, sf), None, d.AS_OF, 168))


_WEEK = f"started_at >= {_AS_OF} - INTERVAL 168 HOUR AND started_at <= {_AS_OF}"


@query(
    "overview",
    "traces",
    f"""WITH pair AS ({_PAIR}),
    st AS (SELECT project_id, round(coalesce(sum(cost_usd), 0e0), 9) AS total_cost_usd,
        CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_latency_ms,
        CAST(floor(quantile_cont(latency_ms, 0.95) + 0.5) AS BIGINT) AS p95_latency_ms
      FROM spans WHERE {_WEEK} GROUP BY 1),
    mo AS (SELECT project_id, round(coalesce(sum(cost_usd), 0e0), 9) AS month_cost_usd FROM spans
      WHERE started_at >= date_trunc('month', {_AS_OF}) AND started_at <= {_AS_OF} GROUP BY 1),
    act AS (SELECT project_id, count(*) FILTER (status = 'running') AS active_traces FROM traces GROUP BY 1),
    md AS (SELECT project_id, string_agg(model || ':' || n, ',' ORDER BY n DESC, model) AS models FROM (
        SELECT project_id, model, count(*) AS n FROM spans WHERE {_WEEK} AND model IS NOT NULL GROUP BY 1, 2)
      GROUP BY 1),
    er AS (SELECT project_id, string_agg(trace_id, ',' ORDER BY started_at DESC, trace_id) AS recent FROM (
        SELECT * FROM (SELECT * FROM spans WHERE status = 'error' AND {_WEEK}
          QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY started_at DESC, span_id) = 1)
        QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, span_id) <= 5)
      GROUP BY 1),
    hr AS (SELECT project_id, count(*) AS spans_in_hours FROM spans WHERE {_WEEK} GROUP BY 1)
    SELECT pair.*, st.* EXCLUDE (project_id), month_cost_usd, active_traces, models, recent,
      CAST(spans_in_hours AS BIGINT) AS spans_in_hours
    FROM pair LEFT JOIN st USING (project_id) LEFT JOIN mo USING (project_id) LEFT JOIN act USING (project_id)
    LEFT JOIN md USING (project_id) LEFT JOIN er USING (project_id) LEFT JOIN hr USING (project_id)""",
)
def _(spark, sf):
    page = overview.overview(d.spans(spark, sf), d.traces(spark, sf), None, d.AS_OF, 168)
    return page.select(
        "project_id", "total_requests", "error_count", "total_requests_prev", "error_count_prev",
        "total_cost_usd", "avg_latency_ms", "p95_latency_ms", "month_cost_usd", "active_traces",
        F.transform("model_usage", lambda m: F.concat_ws(":", m["model"], m["calls"])).alias("models"),
        F.transform("recent_errors", lambda e: e["trace_id"]).alias("recent"),
        F.aggregate("hourly_volume", F.lit(0).cast("bigint"), lambda n, h: n + h["total"]).alias(
            "spans_in_hours"
        ),
    )


_PREV = """started_at >= TIMESTAMP '2024-01-02 00:00:00' AND started_at <= TIMESTAMP '2024-01-16 00:00:00'"""
_PERIOD_COSTS = f"""SELECT project_id,
    coalesce(sum(cost_usd) FILTER ({_IN_PERIOD}), 0e0) AS total_cost_usd,
    CAST(coalesce(sum(input_tokens) FILTER ({_IN_PERIOD}), 0) AS BIGINT) AS total_input_tokens,
    CAST(coalesce(sum(output_tokens) FILTER ({_IN_PERIOD}), 0) AS BIGINT) AS total_output_tokens,
    coalesce(sum(cost_usd) FILTER ({_PREV}), 0e0) AS prev_period_cost_usd
  FROM spans WHERE started_at >= TIMESTAMP '2024-01-02 00:00:00' AND started_at <= TIMESTAMP '{PERIOD[2]}'
  GROUP BY project_id"""


@query(
    "prev_period_cost",
    "spans",
    f"""SELECT project_id, round(coalesce(sum(cost_usd), 0e0), 9) AS prev_period_cost_usd FROM spans
    WHERE {_PREV} GROUP BY project_id""",
)
def _(spark, sf):
    return cost.prev_period_cost(d.spans(spark, sf), *PERIOD)


@query(
    "cost_delta",
    "spans",
    f"""SELECT project_id, round(total_cost_usd, 9) AS total_cost_usd, total_input_tokens, total_output_tokens,
      round(prev_period_cost_usd, 9) AS prev_period_cost_usd,
      CASE WHEN prev_period_cost_usd > 0 THEN round(total_cost_usd - prev_period_cost_usd, 9) END AS delta_usd,
      CASE WHEN prev_period_cost_usd > 0 THEN round((total_cost_usd - prev_period_cost_usd)
        / prev_period_cost_usd * 100, 9) END AS delta_pct
    FROM ({_PERIOD_COSTS})""",
)
def _(spark, sf):
    return cost.cost_delta(cost.period_costs(d.spans(spark, sf), *PERIOD))


_BY_MODEL = f"""WITH {_USAGE} SELECT project_id, model, provider, round(cost_usd, 9) AS cost_usd,
    calls AS span_count, CAST(floor(avg_tokens_per_call + 0.5) AS BIGINT) AS avg_tokens_per_call,
    round(avg_cost_per_call, 6) AS avg_cost_per_call,
    CAST(floor(avg_latency_ms + 0.5) AS BIGINT) AS avg_latency_ms, calls AS call_count FROM usage"""


@query("cost_by_model", "spans", _BY_MODEL)
def _(spark, sf):
    return cost.cost_by_model(d.spans(spark, sf), *RANGE)


@query(
    "model_efficiency_sort",
    "spans",
    f"""SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY avg_latency_ms DESC, model) AS INTEGER) AS place
    FROM ({_BY_MODEL})""",
)
def _(spark, sf):
    by_model = cost.cost_by_model(d.spans(spark, sf), *RANGE)
    return placed(cost.model_efficiency_sort(by_model, "avg_latency_ms"), "project_id")


@query(
    "cost_by_model_pg",
    "spans",
    f"""SELECT project_id, coalesce(model, 'unknown') AS model, coalesce(provider, 'unknown') AS provider,
      round(sum(cost_usd), 9) AS cost_usd, count(*) AS span_count,
      CAST(floor(avg(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) + 0.5) AS BIGINT)
        AS avg_tokens_per_call, round(avg(cost_usd), 6) AS avg_cost_per_call,
      CAST(floor(coalesce(avg(latency_ms), 0e0) + 0.5) AS BIGINT) AS avg_latency_ms
    FROM spans WHERE {_IN} GROUP BY project_id, spans.model, spans.provider""",
)
def _(spark, sf):
    return cost.cost_by_model_pg(d.spans(spark, sf), *RANGE)


_DAILY = _filled(
    "DAY",
    "CAST(started_at AS DATE)",
    "DATE",
    "coalesce(sum(cost_usd), 0e0) AS c",
    "date, round(coalesce(b.c, 0e0), 9) AS cost_usd",
)


@query("cost_by_date", "spans", _DAILY)
def _(spark, sf):
    return cost.cost_by_date(d.spans(spark, sf), *RANGE)


@query("cost_timeseries", "spans", _DAILY)
def _(spark, sf):
    return cost.cost_timeseries(d.spans(spark, sf), *RANGE)


@query(
    "cost_by_date_pg",
    "spans",
    f"""SELECT project_id, CAST(started_at AS DATE) AS date, round(sum(cost_usd), 9) AS cost_usd
    FROM spans WHERE {_IN} GROUP BY 1, 2""",
)
def _(spark, sf):
    return cost.cost_by_date_pg(d.spans(spark, sf), *RANGE)


@query(
    "cost_by_date_split",
    "spans",
    _filled(
        "DAY",
        "CAST(started_at AS DATE)",
        "DATE",
        """coalesce(sum(input_tokens / 1000e0 * price_in), 0e0) AS i,
        coalesce(sum(output_tokens / 1000e0 * price_out), 0e0) AS o""",
        """date, round(coalesce(b.i, 0e0), 9) AS input_cost_usd, round(coalesce(b.o, 0e0), 9) AS output_cost_usd""",
    ),
)
def _(spark, sf):
    return cost.cost_by_date_split(d.spans(spark, sf), *RANGE)


_BY_AGENT = f"""SELECT project_id, agent_name, coalesce(sum(cost_usd), 0e0) AS cost_usd FROM spans
  WHERE {_IN} AND agent_name IS NOT NULL GROUP BY 1, 2"""


@query("cost_by_agent", "spans", f"SELECT * REPLACE (round(cost_usd, 9) AS cost_usd) FROM ({_BY_AGENT})")
def _(spark, sf):
    return cost.cost_by_agent(d.spans(spark, sf), *RANGE)


@query(
    "agent_cost_share",
    "spans",
    f"""SELECT project_id, agent_name, round(cost_usd, 9) AS cost_usd,
      round(cost_usd / sum(cost_usd) OVER (PARTITION BY project_id) * 100, 9) AS share_pct FROM ({_BY_AGENT})""",
)
def _(spark, sf):
    return cost.agent_cost_share(cost.cost_by_agent(d.spans(spark, sf), *RANGE), ["project_id"])


@query(
    "cost_by_agent_pg",
    "traces",
    f"""SELECT s.project_id, coalesce(t.agent_name, 'unknown') AS agent_name, round(sum(s.cost_usd), 9) AS cost_usd
    FROM spans s JOIN traces t USING (trace_id)
    WHERE s.started_at >= TIMESTAMP '{d.START}' AND s.started_at <= TIMESTAMP '{d.END}' GROUP BY 1, 2""",
)
def _(spark, sf):
    return cost.cost_by_agent_pg(d.spans(spark, sf), d.traces(spark, sf), *RANGE)


@query(
    "top_cost_model_agent",
    "spans",
    f"""WITH {_USAGE}, m AS (SELECT project_id, arg_min(model, (-round(cost_usd, 9), -calls, model))
        AS most_expensive_model FROM usage GROUP BY 1),
    a AS (SELECT project_id, arg_min(agent_name, (-round(cost_usd, 9), agent_name)) AS most_expensive_agent
      FROM ({_BY_AGENT}) GROUP BY 1)
    SELECT * FROM m JOIN a USING (project_id)""",
)
def _(spark, sf):
    return cost.top_cost_model_agent(d.spans(spark, sf), *RANGE)


@query(
    "budget_status",
    "spans projects",
    f"""SELECT project_id, monthly_budget_usd, round(m, 9) AS month_cost_usd, round(pct, 9) AS used_pct,
      CASE WHEN pct >= 100 THEN 'over' WHEN pct >= 80 THEN 'warn' ELSE 'ok' END AS budget_state,
      round(monthly_budget_usd - m, 9) AS remaining_usd
    FROM (SELECT p.project_id, p.monthly_budget_usd, coalesce(c.m, 0e0) AS m,
        least(coalesce(c.m, 0e0) / p.monthly_budget_usd * 100, 100e0) AS pct
      FROM projects p LEFT JOIN (SELECT project_id, sum(cost_usd) AS m FROM spans
        WHERE started_at >= date_trunc('month', {_AS_OF}) AND started_at <= {_AS_OF} GROUP BY 1) c USING (project_id)
      WHERE p.monthly_budget_usd > 0)""",
)
def _(spark, sf):
    return cost.budget_status(d.spans(spark, sf), d.projects(spark), None, d.AS_OF)


_MID = "2024-01-11 06:30:00"


@query(
    "budget_status_mid_month",
    "spans projects",
    f"""SELECT p.project_id, p.monthly_budget_usd, round(coalesce(m, 0e0), 9) AS month_cost_usd
    FROM projects p LEFT JOIN (SELECT project_id, sum(cost_usd) AS m FROM spans
      WHERE started_at >= TIMESTAMP '2024-01-01 00:00:00' AND started_at <= TIMESTAMP '{_MID}' GROUP BY 1)
      USING (project_id) WHERE p.monthly_budget_usd > 0""",
)
def _(spark, sf):
    status = cost.budget_status(d.spans(spark, sf), d.projects(spark), None, _MID)
    return status.select("project_id", "monthly_budget_usd", "month_cost_usd")


@query(
    "cost_summary",
    "spans projects",
    f"""WITH pc AS ({_PERIOD_COSTS}),
    mo AS (SELECT project_id, sum(cost_usd) AS m FROM spans
      WHERE started_at >= date_trunc('month', {_AS_OF}) AND started_at <= {_AS_OF} GROUP BY 1),
    md AS (SELECT project_id, string_agg(model, ',' ORDER BY n DESC, model) AS models FROM (
      SELECT project_id, model, count(*) AS n FROM spans WHERE {_IN_PERIOD} AND model IS NOT NULL GROUP BY 1, 2)
      GROUP BY 1),
    ag AS (SELECT project_id, string_agg(agent_name, ',' ORDER BY agent_name) AS agents FROM (
      SELECT DISTINCT project_id, agent_name FROM spans WHERE {_IN_PERIOD} AND agent_name IS NOT NULL)
      GROUP BY 1),
    dt AS (SELECT project_id, sum(cost_usd) AS daily_total FROM spans WHERE {_IN_PERIOD} GROUP BY 1)
    SELECT pc.project_id, round(total_cost_usd, 9) AS total_cost_usd, total_input_tokens, total_output_tokens,
      round(prev_period_cost_usd, 9) AS prev_period_cost_usd, round(m, 9) AS month_cost_usd,
      monthly_budget_usd, models, agents, round(daily_total, 9) AS daily_total
    FROM pc LEFT JOIN mo USING (project_id) LEFT JOIN projects USING (project_id)
    LEFT JOIN md USING (project_id) LEFT JOIN ag USING (project_id) LEFT JOIN dt USING (project_id)""",
)
def _(spark, sf):
    page = cost.cost_summary(d.spans(spark, sf), d.projects(spark), *PERIOD, as_of=d.AS_OF)
    return page.select(
        "project_id", "total_cost_usd", "total_input_tokens", "total_output_tokens",
        "prev_period_cost_usd", "month_cost_usd", "monthly_budget_usd",
        F.transform("by_model", lambda m: m["model"]).alias("models"),
        F.transform("by_agent", lambda a: a["agent_name"]).alias("agents"),
        F.aggregate("by_date", F.lit(0.0), lambda t, x: t + x["cost_usd"]).alias("daily_total"),
    )


_STATS = f"""SELECT project_id, count(DISTINCT trace_id) AS total_traces,
    count(*) FILTER (status = 'error') AS error_count, coalesce(avg(latency_ms), 0e0) AS avg_latency_ms,
    coalesce(sum(cost_usd), 0e0) AS total_cost_usd
  FROM spans WHERE started_at >= TIMESTAMP '{PERIOD[1]}'
    AND started_at <= TIMESTAMP '{PERIOD[2]}' + INTERVAL 1 DAY GROUP BY project_id"""
_RATES = """project_id, total_traces, error_count, round(avg_latency_ms, 9) AS avg_latency_ms,
  round(total_cost_usd, 9) AS total_cost_usd, total_traces - error_count AS success_count,
  round((total_traces - error_count) / total_traces, 9) AS success_rate"""


@query("trace_stats", "spans", f"SELECT {_RATES} FROM ({_STATS})")
def _(spark, sf):
    return traces.trace_stats(d.spans(spark, sf), *PERIOD)


@query(
    "trace_stats_pg",
    "traces",
    f"""SELECT {_RATES} FROM (SELECT project_id, count(*) AS total_traces,
        count(*) FILTER (status = 'error') AS error_count,
        coalesce(avg(total_latency_ms), 0e0) AS avg_latency_ms,
        coalesce(sum(total_cost_usd), 0e0) AS total_cost_usd
      FROM traces WHERE started_at >= TIMESTAMP '{PERIOD[1]}'
        AND started_at < TIMESTAMP '2024-01-31 00:00:00' GROUP BY project_id)""",
)
def _(spark, sf):
    return traces.trace_stats_pg(d.traces(spark, sf), *PERIOD)


@query(
    "avg_cost_per_trace",
    "spans",
    f"SELECT project_id, round(total_cost_usd / total_traces, 6) AS avg_cost_usd FROM ({_STATS})",
)
def _(spark, sf):
    stats = traces.avg_cost_per_trace(traces.trace_stats(d.spans(spark, sf), *PERIOD))
    return stats.select("project_id", "avg_cost_usd")


@query(
    "error_rate",
    "spans",
    f"""SELECT project_id, round(1 - (total_traces - error_count) / total_traces, 9) AS error_rate
    FROM ({_STATS})""",
)
def _(spark, sf):
    stats = traces.error_rate(traces.trace_stats(d.spans(spark, sf), *PERIOD))
    return stats.select("project_id", "error_rate")
