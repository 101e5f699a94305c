"""Spans rolled up into traces and sessions.

The roll-up has two stages, so that the stream and the batch share it: mergeable
partial rows per trace, and their final form. Both stages are plain aggregates
with map-side combine; a trace that holds most spans costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.spans import total_tokens
from spanmill.operators.enrich import insert_spans_first_wins


def _status_rank() -> Column:
    return F.when(F.col("status") == "error", 3).when(F.col("status") == "timeout", 2).otherwise(1)


def _status_name(rank: str) -> Column:
    return F.when(F.col(rank) == 3, "error").when(F.col(rank) == 2, "timeout").otherwise("success")


def trace_partials(spans: DataFrame) -> DataFrame:
    """Mergeable totals per trace; order comes from ``arrival_seq``."""
    is_root = F.col("parent_span_id").isNull()
    root_seq = F.when(is_root & F.col("name").isNotNull(), F.col("arrival_seq"))
    session = F.col("session_id") if "session_id" in spans.columns else F.lit(None).cast("string")
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("total_spans"),
        F.sum(total_tokens()).alias("total_tokens"),
        F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("total_cost_usd"),
        F.sum(F.coalesce("latency_ms", F.lit(0)).cast("bigint")).alias("total_latency_ms"),
        F.max(_status_rank()).alias("status_rank"),
        F.min(
            F.struct("arrival_seq", "started_at", "project_id", "metadata")
        ).alias("first_span"),
        F.min(F.when(root_seq.isNotNull(), F.struct(root_seq.alias("seq"), "name"))).alias("agent"),
        F.max(
            F.when(
                F.col("ended_at").isNotNull(), F.struct(F.col("arrival_seq").alias("seq"), "ended_at")
            )
        ).alias("last_end"),
        F.min(
            F.when(session.isNotNull(), F.struct(F.col("arrival_seq").alias("seq"), session.alias("id")))
        ).alias("session"),
    )


def merge_trace_partials(partials: DataFrame) -> DataFrame:
    """Partial rows of the same trace, from any number of batches, as one."""
    sums = ("total_spans", "total_tokens", "total_cost_usd", "total_latency_ms")
    return partials.groupBy("trace_id").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max("status_rank").alias("status_rank"),
        F.min("first_span").alias("first_span"),
        F.min("agent").alias("agent"),
        F.max("last_end").alias("last_end"),
        F.min("session").alias("session"),
    )


def finish_traces(partials: DataFrame) -> DataFrame:
    """Trace rows from one partial row per trace."""
    return partials.select(
        "trace_id",
        F.col("first_span.project_id").alias("project_id"),
        F.col("session.id").alias("session_id"),
        F.col("agent.name").alias("agent_name"),
        _status_name("status_rank").alias("status"),
        "total_spans",
        "total_tokens",
        "total_cost_usd",
        "total_latency_ms",
        F.col("first_span.started_at").alias("started_at"),
        F.col("last_end.ended_at").alias("ended_at"),
        F.col("first_span.metadata").alias("metadata"),
    )


def trace_rollup(spans: DataFrame, count_duplicates: bool = False) -> DataFrame:
    """Running totals per trace in order of arrival.

    The agent is the first root name, the start and metadata are those of the
    first arriving span, the end that of the last arriving span that has one, and
    the status is error over timeout over success. With ``count_duplicates`` a
    redelivered span adds to the totals again.
    """
    source = spans if count_duplicates else insert_spans_first_wins(_rollup_columns(spans))
    return finish_traces(trace_partials(source))


def _rollup_columns(spans: DataFrame) -> DataFrame:
    """Only what the roll-up reads: the texts must not reach the shuffle."""
    wanted = (
        "span_id", "trace_id", "parent_span_id", "project_id", "name", "input_tokens",
        "output_tokens", "latency_ms", "cost_usd", "status", "metadata", "started_at",
        "ended_at", "session_id", "arrival_seq",
    )
    return spans.select(*[c for c in wanted if c in spans.columns])


def trace_rollup_eventtime(spans: DataFrame) -> DataFrame:
    """The same totals with the earliest start and the latest end of the trace."""
    is_root = F.col("parent_span_id").isNull()
    return (
        spans.groupBy("trace_id")
        .agg(
            F.min("project_id").alias("project_id"),
            F.min(F.when(is_root, F.struct("started_at", "span_id", "name"))).alias("_agent"),
            F.max(_status_rank()).alias("_rank"),
            F.count("*").alias("total_spans"),
            F.sum(total_tokens()).alias("total_tokens"),
            F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("total_cost_usd"),
            F.sum(F.coalesce("latency_ms", F.lit(0)).cast("bigint")).alias("total_latency_ms"),
            F.min("started_at").alias("started_at"),
            F.max("ended_at").alias("ended_at"),
        )
        .withColumn("agent_name", F.col("_agent.name"))
        .withColumn("status", _status_name("_rank"))
        .drop("_agent", "_rank")
    )


def session_rollup(traces: DataFrame) -> DataFrame:
    """Totals per session with its first and last trace."""
    order = F.struct("started_at", "trace_id")
    return (
        traces.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.count("*").alias("traces"),
            F.sum("total_spans").alias("spans"),
            F.sum("total_cost_usd").alias("cost_usd"),
            F.min("started_at").alias("first_at"),
            F.max("started_at").alias("last_at"),
            F.min(order).alias("_first"),
            F.max(order).alias("_last"),
        )
        .withColumn("first_trace_id", F.col("_first.trace_id"))
        .withColumn("last_trace_id", F.col("_last.trace_id"))
        .drop("_first", "_last")
    )


def session_traces(traces: DataFrame, session_id: str | None = None) -> DataFrame:
    """Traces in order within their session: rows in a global sort, not one array per session."""
    kept = traces.filter(F.col("session_id").isNotNull())
    if session_id is not None:
        kept = kept.filter(F.col("session_id") == session_id)
    return kept.orderBy("session_id", "started_at", "trace_id")


def trace_total_tokens(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(F.sum(total_tokens()).alias("total_tokens"))
