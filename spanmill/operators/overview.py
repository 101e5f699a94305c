"""Reports of the overview page.

Without ``project_id`` a report covers every project in one job. Span-grain
reports are the main form; the ``_by_trace`` ones answer from traces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.stats import combined, counted_percentile, gap_filled, js_round, top_k
from spanmill.operators.errors import error_clusters
from spanmill.operators.page import by_model, grouped_counts, listed, magnitude, mean, percentile_of_buckets, single
from spanmill.operators.slices import hours_before, moment, report_keys, time_slice
from spanmill.session import written

_IS_ERROR = "status = 'error'"


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def _zero_double(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def summary_stats(
    spans: DataFrame, project_id=None, start=None, end=None, approx: bool = False
) -> DataFrame:
    """Spans, errors, cost, latency (mean and p95), tokens and distinct traces."""
    keys = report_keys(project_id)
    rows = time_slice(spans, project_id, start, end)
    basics = [
        F.count("*").alias("total_spans"),
        F.count_if(F.expr(_IS_ERROR)).alias("error_count"),
        _zero_double(F.sum("cost_usd")).alias("total_cost_usd"),
        _zero_double(F.avg("latency_ms")).alias("avg_latency_ms"),
        _zero(F.sum("input_tokens")).alias("total_input_tokens"),
        _zero(F.sum("output_tokens")).alias("total_output_tokens"),
    ]
    if approx:
        return rows.groupBy(*keys).agg(
            *basics,
            F.approx_count_distinct("trace_id").alias("unique_traces"),
            _zero_double(F.percentile_approx("latency_ms", 0.95).cast("double")).alias(
                "p95_latency_ms"
            ),
        )
    # Distinct traces have a pass of their own: next to the sketch they would multiply its rows.
    counts = counted_percentile(rows, keys, basics, "latency_ms", 0.95, "p95_latency_ms")
    traces = rows.groupBy(*keys).agg(F.count_distinct("trace_id").alias("unique_traces"))
    return combined(keys, counts, traces).withColumns(
        {"p95_latency_ms": _zero_double(F.col("p95_latency_ms")), "unique_traces": _zero(F.col("unique_traces"))}
    )


def summary_by_trace(traces: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """Trace-grain summary; p95 is over the total latency of traces."""
    keys = report_keys(project_id)
    rows = time_slice(traces, project_id, start, end)
    basics = [
        F.count("*").alias("unique_traces"),
        F.count_if(F.expr(_IS_ERROR)).alias("error_count"),
        _zero_double(F.sum("total_cost_usd")).alias("total_cost_usd"),
        _zero_double(F.avg("total_latency_ms")).alias("avg_latency_ms"),
    ]
    summary = counted_percentile(rows, keys, basics, "total_latency_ms", 0.95, "p95_latency_ms")
    return summary.withColumn("p95_latency_ms", _zero_double(F.col("p95_latency_ms")))


def _in(start, end, open_end: bool = False) -> Column:
    at = F.col("started_at")
    return (at >= moment(start)) & (at < moment(end) if open_end else at <= moment(end))


def prev_window_summary(spans: DataFrame, project_id=None, as_of=None, hours: int = 24) -> DataFrame:
    """Traces and error spans of this window and the one before, in one scan.

    Both windows hold the moment that separates them.
    """
    keys = report_keys(project_id)
    mid, far = hours_before(as_of, hours), hours_before(as_of, 2 * hours)
    now, before = _in(mid, as_of), _in(far, mid)
    error = F.expr(_IS_ERROR)
    by_trace = (
        time_slice(spans, project_id, far, as_of)
        .groupBy(*keys, "trace_id")
        .agg(
            F.count_if(now).alias("_now"),
            F.count_if(before).alias("_before"),
            F.count_if(now & error).alias("_now_err"),
            F.count_if(before & error).alias("_before_err"),
        )
    )
    return by_trace.groupBy(*keys).agg(
        F.count_if(F.col("_now") > 0).alias("total_requests"),
        _zero(F.sum("_now_err")).alias("error_count"),
        F.count_if(F.col("_before") > 0).alias("total_requests_prev"),
        _zero(F.sum("_before_err")).alias("error_count_prev"),
    )


def prev_window_by_trace(traces: DataFrame, project_id=None, as_of=None, hours: int = 24) -> DataFrame:
    """Trace-grain form; the earlier window leaves out the shared moment."""
    keys = report_keys(project_id)
    mid, far = hours_before(as_of, hours), hours_before(as_of, 2 * hours)
    now, before, error = _in(mid, as_of), _in(far, mid, open_end=True), F.expr(_IS_ERROR)
    return (
        time_slice(traces, project_id, far, as_of)
        .groupBy(*keys)
        .agg(
            F.count_if(now).alias("total_requests"),
            F.count_if(now & error).alias("error_count"),
            F.count_if(before).alias("total_requests_prev"),
            F.count_if(before & error).alias("error_count_prev"),
        )
    )


def month_to_date_cost(spans: DataFrame, project_id=None, as_of=None) -> DataFrame:
    """Cost since the start of the UTC month of ``as_of``."""
    start = F.date_trunc("month", moment(as_of))
    return (
        time_slice(spans, project_id, start, as_of)
        .groupBy(*report_keys(project_id))
        .agg(_zero_double(F.sum("cost_usd")).alias("month_cost_usd"))
    )


def _volume(rows: DataFrame, keys: list[str], bucket: Column, name: str) -> DataFrame:
    return rows.groupBy(*keys, bucket.alias(name)).agg(
        F.count("*").alias("total"), F.count_if(F.expr(_IS_ERROR)).alias("errors")
    )


def hourly_volume(spans: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """Spans and errors per hour; empty hours between the first and last one are zero."""
    keys = report_keys(project_id)
    rows = time_slice(spans, project_id, start, end)
    volume = _volume(rows, keys, F.date_trunc("hour", "started_at"), "hour")
    return gap_filled(volume, "hour", "1 HOUR", ["total", "errors"], keys).orderBy(*keys, "hour")


def hourly_volume_by_trace(traces: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """Traces per hour, without gap filling."""
    keys = report_keys(project_id)
    rows = time_slice(traces, project_id, start, end)
    volume = _volume(rows, keys, F.date_trunc("hour", "started_at"), "hour")
    return volume.orderBy(*keys, "hour")


def volume_by_grain(
    spans: DataFrame, grain: str, project_id=None, start=None, end=None
) -> DataFrame:
    """Request volume in buckets of ``1h``, ``24h`` or ``7d``."""
    keys = report_keys(project_id)
    widths = {"1h": "1 hour", "24h": "1 day", "7d": "7 days"}
    rows = time_slice(spans, project_id, start, end)
    bucket = F.window("started_at", widths[grain])["start"]
    return _volume(rows, keys, bucket, "bucket").orderBy(*keys, "bucket")


def model_usage(
    spans: DataFrame, project_id=None, start=None, end=None, limit: int | None = 50
) -> DataFrame:
    """Busiest models (``limit=None``: all) with their usual provider, cost, tokens and latency."""
    keys = report_keys(project_id)
    rows = time_slice(spans, project_id, start, end).filter(F.col("model").isNotNull())
    by_provider = rows.groupBy(*keys, "model", "provider").agg(
        F.count("*").alias("_n"),
        F.sum("cost_usd").alias("_cost"),
        F.sum("latency_ms").alias("_lat"),
        F.count("latency_ms").alias("_lat_n"),
        F.sum("input_tokens").alias("_in"),
        F.count("input_tokens").alias("_in_n"),
        F.sum("output_tokens").alias("_out"),
        F.count("output_tokens").alias("_out_n"),
    )
    # Most common provider, ties by name: the least of (-count, name).
    provider = F.min(
        F.when(F.col("provider").isNotNull(), F.struct((-F.col("_n")).alias("n"), "provider"))
    )["provider"]
    mean = lambda total, n: F.coalesce(
        F.try_divide(F.sum(total), F.sum(n)), F.lit(0.0)
    )
    usage = by_provider.groupBy(*keys, "model").agg(
        F.coalesce(provider, F.lit("unknown")).alias("provider"),
        F.sum("_n").alias("calls"),
        _zero_double(F.sum("_cost")).alias("cost_usd"),
        (mean("_in", "_in_n") + mean("_out", "_out_n")).alias("avg_tokens_per_call"),
        (_zero_double(F.sum("_cost")) / F.sum("_n")).alias("avg_cost_per_call"),
        mean("_lat", "_lat_n").alias("avg_latency_ms"),
    )
    return top_k(usage, keys, [F.desc("calls"), F.asc("model")], limit)


def model_usage_pg(spans: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """All models with calls and cost, busiest first."""
    keys = report_keys(project_id)
    rows = time_slice(spans, project_id, start, end).filter(F.col("model").isNotNull())
    return (
        rows.groupBy(*keys, "model")
        .agg(F.count("*").alias("calls"), _zero_double(F.sum("cost_usd")).alias("cost_usd"))
        .orderBy(*keys, F.desc("calls"), "model")
    )


def top_agents(spans: DataFrame, project_id=None, start=None, end=None, limit: int = 5) -> DataFrame:
    """Agents with most spans: traces, traces with errors, latency, cost."""
    keys = report_keys(project_id)
    rows = time_slice(spans, project_id, start, end).filter(F.col("agent_name").isNotNull())
    # Two levels instead of two distinct counts, which would triple the rows.
    by_trace = rows.groupBy(*keys, "agent_name", "trace_id").agg(
        F.count("*").alias("_n"),
        F.count_if(F.expr(_IS_ERROR)).alias("_err"),
        F.sum("latency_ms").alias("_lat"),
        F.count("latency_ms").alias("_lat_n"),
        F.sum("cost_usd").alias("_cost"),
    )
    agents = by_trace.groupBy(*keys, "agent_name").agg(
        F.sum("_n").alias("_spans"),
        F.count("*").alias("trace_count"),
        F.count_if(F.col("_err") > 0).alias("error_count"),
        F.coalesce(F.try_divide(F.sum("_lat"), F.sum("_lat_n")), F.lit(0.0)).alias("avg_latency_ms"),
        _zero_double(F.sum("_cost")).alias("cost_usd"),
    )
    return top_k(agents, keys, [F.desc("_spans"), F.asc("agent_name")], limit).drop("_spans")


def top_agents_by_trace(
    traces: DataFrame, project_id=None, start=None, end=None, limit: int = 5
) -> DataFrame:
    """Agents with most traces; traces without an agent count as ``unknown``."""
    keys = report_keys(project_id)
    agents = (
        time_slice(traces, project_id, start, end)
        .groupBy(*keys, F.coalesce("agent_name", F.lit("unknown")).alias("agent_name"))
        .agg(
            F.count("*").alias("calls"),
            F.count_if(F.expr(_IS_ERROR)).alias("errors"),
            js_round(_zero_double(F.avg("total_latency_ms"))).alias("avg_latency_ms"),
            _zero_double(F.sum("total_cost_usd")).alias("cost_usd"),
        )
    )
    return top_k(agents, keys, [F.desc("calls"), F.asc("agent_name")], limit)


def _newest_error(errors: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Newest error span of each trace; equal times go to the smaller span id."""
    newest = F.min(F.struct((-F.unix_micros("started_at")).alias("_t"), "span_id", *columns))
    return errors.groupBy(*keys, "trace_id").agg(newest.alias("_e"))


def recent_errors(spans: DataFrame, project_id=None, start=None, end=None, limit: int = 5) -> DataFrame:
    """Newest error span of each of the traces that failed last."""
    keys = report_keys(project_id)
    errors = time_slice(spans, project_id, start, end).filter(_IS_ERROR)
    newest = _newest_error(errors, keys, "error_message", "agent_name", "model", "started_at")
    rows = newest.select(*keys, "trace_id", "_e.*")
    top = top_k(rows, keys, [F.asc("_t"), F.asc("span_id")], limit)
    message = F.coalesce(F.nullif(F.col("error_message"), F.lit("")), F.lit("Unknown error"))
    return top.select(
        *keys, "trace_id", message.alias("error_message"), "agent_name", "model", "started_at"
    )


def recent_errors_by_trace(
    traces: DataFrame, spans: DataFrame, project_id=None, start=None, end=None, limit: int = 5
) -> DataFrame:
    """Newest error traces with the message and model of their newest error span."""
    keys = report_keys(project_id)
    failed = time_slice(traces, project_id, start, end).filter(_IS_ERROR)
    # The limit comes first, so only a handful of traces meets the spans.
    top = top_k(failed, keys, [F.desc("started_at"), F.asc("trace_id")], limit).select(
        *keys, "trace_id", "agent_name", "started_at"
    )
    errors = spans.filter(_IS_ERROR).join(top.select("trace_id"), "trace_id", "left_semi")
    newest = _newest_error(errors, [], "error_message", "model")
    return top.join(newest, "trace_id", "left").select(
        *keys,
        "trace_id",
        F.coalesce("_e.error_message", F.lit("Unknown error")).alias("error_message"),
        "agent_name",
        F.col("_e.model").alias("model"),
        "started_at",
    )


def active_traces(traces: DataFrame, project_id=None) -> DataFrame:
    """Traces with status ``running``; zero for projects without any."""
    return (
        time_slice(traces, project_id)
        .groupBy(*report_keys(project_id))
        .agg(F.count_if(F.col("status") == "running").alias("active_traces"))
    )


def overview_deltas(pairs: DataFrame) -> DataFrame:
    """Changes in percent against the previous window; null where that was empty.

    The error rate is error spans per trace, so it can exceed 100.
    """
    change = lambda now, before: F.when(
        F.col(before) > 0, (F.col(now) - F.col(before)) / F.col(before) * 100
    )
    rate = F.when(
        F.col("total_requests") > 0, F.col("error_count") / F.col("total_requests") * 100
    ).otherwise(0.0)
    return pairs.withColumns(
        {
            "request_delta_pct": change("total_requests", "total_requests_prev"),
            "error_rate_pct": rate,
            "error_delta_pct": change("error_count", "error_count_prev"),
        }
    )


def model_share(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Calls in percent of the busiest model (the rows of ``usage``, all models by ``limit=None``)."""
    keys = keys or []
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    busiest = F.max("calls").over(window)
    return usage.withColumn(
        "share_pct", F.when(busiest > 0, F.col("calls") / busiest * 100).otherwise(0.0)
    )


#: Sets of dimensions that the overview counts by.
_KINDS = {"total": [], "hour": ["hour"], "model": ["model", "provider"], "trace": ["agent_name", "trace_id"], "latency": ["bucket"]}


def _page_counts(spans: DataFrame, project_id, as_of, hours: int) -> DataFrame:
    """Everything that the overview counts, from one scan of the month and both windows."""
    mid, far = hours_before(as_of, hours), hours_before(as_of, 2 * hours)
    first = F.date_trunc("month", moment(as_of))
    now, before, month = _in(mid, as_of), _in(far, mid), F.col("started_at") >= first
    error = F.expr(_IS_ERROR)
    # Outside its window a dimension is null, so rows of the month alone combine to one.
    inside = lambda value, when=now: F.when(when, value)
    rows = time_slice(spans, project_id, F.least(far, first), as_of).select(
        "project_id",
        inside(F.date_trunc("hour", "started_at")).alias("hour"),
        *[inside(F.col(c)).alias(c) for c in ("model", "provider")],
        *[inside(F.col(c), now | before).alias(c) for c in ("agent_name", "trace_id")],
        inside(magnitude(F.col("latency_ms"))).alias("bucket"),
        now.alias("now"), before.alias("before"), month.alias("month"), error.alias("error"),
        inside(F.col("cost_usd")).alias("cost"),
        F.when(month, F.col("cost_usd")).alias("cost_month"),
        *[inside(F.col(c)).alias(c) for c in ("latency_ms", "input_tokens", "output_tokens")],
    )
    return grouped_counts(
        rows,
        _KINDS,
        F.count_if("now").alias("n"),
        F.count_if(F.col("now") & F.col("error")).alias("errors"),
        F.count_if("before").alias("n_before"),
        F.count_if(F.col("before") & F.col("error")).alias("errors_before"),
        F.count_if("month").alias("n_month"),
        F.sum("cost").alias("cost"),
        F.sum("cost_month").alias("cost_month"),
        *[
            agg(c).alias(name)
            for c, total, n in (("latency_ms", "latency", "n_latency"), ("input_tokens", "tokens_in", "n_in"), ("output_tokens", "tokens_out", "n_out"))
            for agg, name in ((F.sum, total), (F.count, n))
        ],
    )


def _page_windows(counts: DataFrame) -> DataFrame:
    """Traces and error spans of both windows of each project with a span in them."""
    sums = [F.sum(c).alias(c) for c in ("n", "errors", "n_before", "errors_before")]
    by_trace = counts.filter("kind = 'trace' AND n + n_before > 0").groupBy("project_id", "trace_id").agg(*sums)
    return by_trace.groupBy("project_id").agg(
        F.count_if(F.col("n") > 0).alias("total_requests"),
        F.sum("errors").alias("error_count"),
        F.count_if(F.col("n_before") > 0).alias("total_requests_prev"),
        F.sum("errors_before").alias("error_count_prev"),
    )


def _page_agents(counts: DataFrame) -> DataFrame:
    """The agents with most spans, from one row per agent and trace."""
    agents = (
        counts.filter("kind = 'trace' AND n > 0 AND agent_name IS NOT NULL")
        .groupBy("project_id", "agent_name")
        .agg(
            F.sum("n").alias("_spans"),
            F.count("*").alias("trace_count"),
            F.count_if(F.col("errors") > 0).alias("error_count"),
            js_round(mean("latency", "n_latency")).alias("avg_latency_ms"),
            _zero_double(F.sum("cost")).alias("cost_usd"),
        )
    )
    return top_k(agents, ["project_id"], [F.desc("_spans"), F.asc("agent_name")], 5)


def overview(
    spans: DataFrame, traces: DataFrame, project_id=None, as_of=None, hours: int = 24
) -> DataFrame:
    """The whole page as one row per project: scalars, and short arrays of structs.

    The stored spans are scanned three times: once to count by all dimensions of the page
    (written: a row per hour, model, latency bucket, and trace of both windows), once for the
    latencies next to the percentile, once for the failed spans of the window (written, narrow).
    Arrays are bounded by the reports behind them (hours of the window, 50 models,
    5 agents, 5 errors, 10 clusters). A project without spans in a part has nulls there; with
    ``project_id`` there is always one row, with zeros and empty arrays.
    """
    start, keys = hours_before(as_of, hours), ["project_id"]
    window = time_slice(spans, project_id, start, as_of)
    counts = written(_page_counts(spans, project_id, as_of, hours), "page-counts")
    failed = window.filter(_IS_ERROR).select(
        *keys, "trace_id", "span_id", "agent_name", "model", "status", "error_message", "started_at"
    )
    failed = written(failed, "page-errors")
    totals = counts.filter("kind = 'total'")
    stats = totals.filter("n > 0").select(
        *keys,
        _zero_double(F.col("cost")).alias("total_cost_usd"),
        js_round(F.coalesce(F.try_divide("latency", "n_latency"), F.lit(0.0))).alias("avg_latency_ms"),
        F.when(F.col("n_latency") == 0, F.lit(0).cast("bigint")).alias("p95_latency_ms"),
    )
    buckets = counts.filter("kind = 'latency' AND bucket IS NOT NULL").select(*keys, "bucket", "n")
    p95 = percentile_of_buckets(buckets, window, "latency_ms", 0.95, "p95")
    volume = counts.filter("kind = 'hour' AND n > 0").select(*keys, "hour", F.col("n").alias("total"), "errors")
    stats = stats.join(p95.select(F.col("project_id").alias("_of"), "p95"), F.col("project_id").eqNullSafe(F.col("_of")), "left")
    page = combined(
        keys,
        _page_windows(counts),
        stats.withColumn("p95_latency_ms", F.coalesce("p95_latency_ms", js_round(F.col("p95")))).drop("_of", "p95"),
        totals.filter("n_month > 0").select(*keys, _zero_double(F.col("cost_month")).alias("month_cost_usd")),
        active_traces(traces if project_id is None else time_slice(traces, project_id)),
        listed(gap_filled(volume, "hour", "1 HOUR", ["total", "errors"], keys), "hourly_volume", [F.col("hour")], "hour", "total", "errors"),
        listed(
            top_k(by_model(counts), keys, [F.desc("calls"), F.asc("model")], 50),
            "model_usage",
            [-F.col("calls"), F.col("model")],
            "model", "calls", "cost_usd",
        ),
        listed(
            _page_agents(counts),
            "top_agents",
            [-F.col("trace_count"), F.col("agent_name")],
            "agent_name", "trace_count", "error_count", "avg_latency_ms", "cost_usd",
        ),
        listed(
            recent_errors(failed),
            "recent_errors",
            [-F.unix_micros("started_at"), F.col("trace_id")],
            "trace_id", "error_message", "agent_name", "model", "started_at",
        ),
        listed(
            error_clusters(failed),
            "error_clusters",
            [-F.col("span_count"), F.col("pattern")],
            "pattern", "count", "trace_ids", "models", "last_seen",
        ),
    )
    return page if project_id is None else single(page)
