"""Trace statistics, listings, paging and lookups."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.spans import in_range
from spanmill.functions.text import chat_messages
from spanmill.operators.enrich import input_preview
from spanmill.operators.search import matching_spans, search_spans
from spanmill.operators.slices import moment, report_keys, time_slice
from spanmill.session import written

MAX_PAGE = 100


def _next_day(end) -> Column:
    return moment(end) + F.make_dt_interval(days=F.lit(1))


def _with_rate(stats: DataFrame) -> DataFrame:
    success = F.col("total_traces") - F.col("error_count")
    rate = F.when(F.col("total_traces") > 0, success / F.col("total_traces")).otherwise(0.0)
    return stats.withColumn("success_count", success).withColumn("success_rate", rate)


def trace_stats(spans: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """Distinct traces against error spans, up to one day after ``end``.

    The two counts have different grain, so ``success_count`` can be negative.
    """
    until = None if end is None else _next_day(end)
    return _with_rate(
        time_slice(spans, project_id, start, until)
        .groupBy(*report_keys(project_id))
        .agg(
            F.count_distinct("trace_id").alias("total_traces"),
            F.count_if(F.col("status") == "error").alias("error_count"),
            F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        )
    )


def trace_stats_pg(traces: DataFrame, project_id=None, start=None, end=None) -> DataFrame:
    """Trace-grain statistics; the day after ``end`` itself is left out."""
    until = None if end is None else _next_day(moment(end).cast("date").cast("timestamp"))
    return _with_rate(
        time_slice(traces, project_id, start, until, open_end=True)
        .groupBy(*report_keys(project_id))
        .agg(
            F.count("*").alias("total_traces"),
            F.count_if(F.col("status") == "error").alias("error_count"),
            F.coalesce(F.avg("total_latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
            F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        )
    )


def avg_cost_per_trace(stats: DataFrame) -> DataFrame:
    """Add the mean cost of a trace, to 6 places."""
    mean = F.col("total_cost_usd") / F.col("total_traces")
    rounded = F.when(F.col("total_traces") > 0, F.round(mean, 6)).otherwise(0.0)
    return stats.withColumn("avg_cost_usd", rounded)


def error_rate(stats: DataFrame) -> DataFrame:
    return stats.withColumn("error_rate", 1 - F.col("success_rate"))


def _like(text: str) -> str:
    return f"%{text}%"


def list_traces(
    traces: DataFrame,
    spans: DataFrame | None = None,
    *,
    project_id: str | None = None,
    status: str | None = None,
    agent_name: str | None = None,
    search: str | None = None,
    search_size: int | None = None,
    start=None,
    end=None,
    model: str | None = None,
    latency: tuple[int | None, int | None] = (None, None),
    cost: tuple[float | None, float | None] = (None, None),
) -> DataFrame:
    """Traces that pass all given filters.

    ``search`` keeps the traces of all matching spans (or of the ``search_size``
    newest ones), or those whose agent contains the text if no span matches. ``model`` keeps the
    traces with a span of such a model. Both need ``spans``.
    """
    rows = time_slice(traces, project_id, start, end)
    rows = rows.filter(in_range(F.col("total_latency_ms"), *latency))
    rows = rows.filter(in_range(F.col("total_cost_usd"), *cost))
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if agent_name is not None:
        rows = rows.filter(F.col("agent_name").ilike(_like(agent_name)))
    if model is not None:
        matching = time_slice(spans, project_id).filter(F.col("model").ilike(_like(model)))
        rows = rows.join(matching.select("trace_id"), "trace_id", "left_semi")
    if search:
        hits = (
            matching_spans(spans, search, project_id)
            if search_size is None
            else search_spans(spans, search, project_id=project_id, size=search_size)
        )
        # The texts are searched once; both branches read the ids found.
        found = written(hits.select("trace_id").distinct(), "search-hits")
        by_text = rows.join(found, "trace_id", "left_semi")
        by_agent = rows.filter(F.col("agent_name").ilike(_like(search)) & ~found.exists())
        rows = by_text.unionByName(by_agent)
    return rows


def trace_total(listed: DataFrame) -> DataFrame:
    """Number of traces that pass the filters, whatever the page."""
    return listed.agg(F.count("*").alias("total"))


def encode_cursor(started_at: Column, trace_id: Column) -> Column:
    stamp = F.date_format(started_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    payload = F.to_json(F.struct(stamp.alias("startedAt"), trace_id.alias("id")))
    # Spark breaks base64 into lines.
    return F.regexp_replace(F.base64(payload.cast("binary")), r"\s", "")


def decode_cursor(cursor: str) -> tuple[str, str]:
    payload = json.loads(base64.b64decode(cursor))
    return payload["startedAt"], payload["id"]


def trace_page(
    listed: DataFrame, limit: int = 20, cursor: str | None = None
) -> DataFrame:
    """One page, newest first, plus ``next_cursor`` on its last row if more follows.

    The page is a top-k of ``limit + 1`` rows; earlier pages are never read again.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows")
    rows = listed
    if cursor is not None:
        at, trace_id = decode_cursor(cursor)
        at = moment(at)
        before = (F.col("started_at") < at) | (
            (F.col("started_at") == at) & (F.col("trace_id") < trace_id)
        )
        rows = rows.filter(before)
    order = [F.desc("started_at"), F.desc("trace_id")]
    page = rows.orderBy(*order).limit(limit + 1)
    # The window runs over the limit + 1 rows of the page only.
    window = Window.partitionBy(F.lit(0)).orderBy(*order)
    numbered = page.withColumn("_row", F.row_number().over(window)).withColumn(
        "_more", F.lead("trace_id").over(window).isNotNull()
    )
    last = (F.col("_row") == limit) & F.col("_more")
    return (
        numbered.withColumn(
            "next_cursor", F.when(last, encode_cursor(F.col("started_at"), F.col("trace_id")))
        )
        .filter(F.col("_row") <= limit)
        .drop("_row", "_more")
    )


def with_preview(page: DataFrame, spans: DataFrame) -> DataFrame:
    """Add ``input_preview`` to a page of traces (at most 100 rows)."""
    on_page = spans.join(F.broadcast(page.select("trace_id")), "trace_id", "left_semi")
    return page.join(input_preview(on_page), "trace_id", "left")


def trace_preview_or_error(traces: DataFrame, spans: DataFrame, length: int = 60) -> DataFrame:
    """The newest error message of a failed trace, else its first user message, cut."""
    # The texts are cut before the shuffle.
    users = F.filter(chat_messages(F.col("input")), lambda m: m["role"] == "user")
    first_user = F.coalesce(F.get(users, F.lit(0))["content"], F.col("input"))
    roots = spans.filter(F.col("parent_span_id").isNull() & F.col("input").isNotNull())
    previews = roots.select(
        "trace_id",
        F.struct(
            "started_at", "span_id", F.left(first_user, F.lit(length)).alias("preview")
        ).alias("_p"),
    )
    errors = spans.filter((F.col("status") == "error") & F.col("error_message").isNotNull()).select(
        "trace_id",
        F.struct(
            (-F.unix_micros("started_at")).alias("t"), "span_id", "error_message"
        ).alias("_e"),
    )
    found = (
        previews.unionByName(errors, allowMissingColumns=True)
        .groupBy("trace_id")
        .agg(F.min("_p").alias("_p"), F.min("_e").alias("_e"))
    )
    text = F.when(
        F.col("status") == "error", F.coalesce("_e.error_message", "_p.preview")
    ).otherwise(F.col("_p.preview"))
    return traces.join(found, "trace_id", "left").withColumn("preview", text).drop("_p", "_e")


def span_detail(spans: DataFrame, span_id: str, project_id: str) -> DataFrame:
    return spans.filter((F.col("span_id") == span_id) & (F.col("project_id") == project_id))


def spans_by_trace(spans: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Spans in order of their start, of one trace or trace after trace."""
    rows = spans if trace_id is None else spans.filter(F.col("trace_id") == trace_id)
    return rows.orderBy("trace_id", "started_at", "span_id")


def list_spans_legacy(
    spans: DataFrame,
    *,
    project_id: str,
    trace_id: str | None = None,
    status: str | None = None,
    start=None,
    end=None,
    offset: int = 0,
    limit: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """A page of spans, newest first, and the total of the same filters."""
    rows = time_slice(spans, project_id, start, end)
    if trace_id is not None:
        rows = rows.filter(F.col("trace_id") == trace_id)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    page = rows.orderBy(F.desc("started_at"), "span_id").offset(offset).limit(limit)
    return page, rows.agg(F.count("*").alias("total"))
