"""Stages between a valid span and a stored one, and the two duplicate rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.spans import latency_bucket, cost_bucket, span_latency, token_share
from spanmill.functions.text import chat_messages, metadata_get, time_ago
from spanmill.operators.bloom import block_of, bloom_filter, may_hold
from spanmill.session import written

#: Repeated ids (some 60 bytes each) up to this number are broadcast as they are; more are
#: broadcast as a filter of this many blocks (64 bytes each), whatever their number.
BROADCAST_IDS, FILTER_BLOCKS = 500_000, 1 << 16


def _one_per_id(spans: DataFrame, keep) -> DataFrame:
    """The delivery of each span id that ``keep`` (min or max) picks by ``arrival_seq``.

    Only ids and sequence numbers are shuffled to find the repeated ids, which are written, so
    their number is known. Few of them are broadcast, and the spans with their texts are filtered
    where they are. Beyond that a Bloom filter of the repeated ids, of a fixed size, is broadcast:
    spans that it rules out have no repeat and stay where they are, in a scan of their own; only
    the others meet the repeated ids in a shuffle. Without repeats the spans come back as given.
    """
    repeated = (
        spans.groupBy("span_id")
        .agg(F.count("*").alias("_n"), keep("arrival_seq").alias("_kept"))
        .filter("_n > 1 AND span_id IS NOT NULL")
        .drop("_n")
    )
    repeated = written(repeated, "repeated-ids")
    n_repeated = repeated.count()
    if n_repeated == 0:
        return spans
    chosen = F.col("_kept").isNull() | (F.col("arrival_seq") == F.col("_kept"))
    if n_repeated <= BROADCAST_IDS:
        return spans.join(F.broadcast(repeated), "span_id", "left").filter(chosen).select(*spans.columns)
    held = bloom_filter(repeated, "span_id", FILTER_BLOCKS).withColumnRenamed("block", "_block")
    blocked = spans.withColumn("_block", block_of(F.col("span_id"), FILTER_BLOCKS))
    marked = blocked.join(F.broadcast(held), "_block", "left").withColumn("_maybe", may_hold(F.col("span_id")))
    sure = marked.filter("NOT _maybe").select(*spans.columns)
    rest = marked.filter("_maybe").select(*spans.columns).join(repeated, "span_id", "left").filter(chosen)
    return sure.unionByName(rest.select(*spans.columns))


def insert_spans_first_wins(spans: DataFrame) -> DataFrame:
    """One row per span id: the first to arrive (insert-or-ignore)."""
    return _one_per_id(spans, F.min)


def index_spans_last_wins(spans: DataFrame) -> DataFrame:
    """One row per span id: the last to arrive (replace by id)."""
    return _one_per_id(spans, F.max)


def root_agents(spans: DataFrame) -> DataFrame:
    """(trace_id, agent_name, arrival_seq) of the first root to arrive of each trace."""
    return first_agents(
        spans.filter(F.col("parent_span_id").isNull()).select("trace_id", F.col("name").alias("agent_name"), "arrival_seq")
    )


def first_agents(agents: DataFrame) -> DataFrame:
    """The first to arrive of several agents of a trace."""
    return agents.groupBy("trace_id").agg(
        F.min_by("agent_name", "arrival_seq").alias("agent_name"), F.min("arrival_seq").alias("arrival_seq")
    )


def resolve_agent_name(spans: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Agent from the payload, else the own name of a root, else the trace's agent.

    Only child spans without an agent meet the traces, so the shuffle carries no
    rows that already know their answer.
    """
    given = F.nullif(F.col("agent_name"), F.lit(""))
    known = F.coalesce(given, F.when(F.col("parent_span_id").isNull(), F.col("name")))
    resolved = spans.withColumn("agent_name", known)
    traces = root_agents(spans) if traces is None else traces
    agents = traces.select("trace_id", F.col("agent_name").alias("_trace_agent"))
    done = resolved.filter(F.col("agent_name").isNotNull())
    open_rows = resolved.filter(F.col("agent_name").isNull()).join(agents, "trace_id", "left")
    filled = open_rows.withColumn("agent_name", F.col("_trace_agent")).select(*spans.columns)
    return done.select(*spans.columns).unionByName(filled)


def backfill_agent_name(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """Spans without an agent take the agent of their trace, where it has one."""
    agents = traces.filter(F.col("agent_name").isNotNull()).select(
        "trace_id", F.col("agent_name").alias("_trace_agent")
    )
    done = spans.filter(F.col("agent_name").isNotNull())
    open_rows = spans.filter(F.col("agent_name").isNull()).join(agents, "trace_id", "left")
    filled = open_rows.withColumn("agent_name", F.col("_trace_agent")).select(*spans.columns)
    return done.unionByName(filled)


def with_latency(spans: DataFrame) -> DataFrame:
    return spans.withColumn("latency_ms", span_latency())


def input_preview(spans: DataFrame, length: int = 100) -> DataFrame:
    """First characters of the earliest root input of each trace."""
    roots = spans.filter(F.col("parent_span_id").isNull() & F.col("input").isNotNull())
    # Cut before the shuffle: only the preview travels.
    cut = roots.select(
        "trace_id",
        F.left("input", F.lit(length)).alias("input_preview"),
        F.struct("started_at", "span_id").alias("_order"),
    )
    return cut.groupBy("trace_id").agg(F.min_by("input_preview", "_order").alias("input_preview"))


def parse_chat_messages(spans: DataFrame, column: str = "input") -> DataFrame:
    """One row (span_id, position, role, content) per message of a chat transcript."""
    return (
        spans.select("span_id", chat_messages(F.col(column)).alias("_m"))
        .select("span_id", F.posexplode("_m").alias("position", "_m"))
        .select("span_id", "position", "_m.role", "_m.content")
    )


def with_token_share(spans: DataFrame) -> DataFrame:
    return spans.withColumn("_t", token_share()).select(*spans.columns, "_t.*")


def with_buckets(df: DataFrame, latency: str, cost: str) -> DataFrame:
    """Add the report labels ``latency_bucket`` and ``cost_bucket``."""
    return df.withColumn("latency_bucket", latency_bucket(F.col(latency))).withColumn(
        "cost_bucket", cost_bucket(F.col(cost))
    )


def with_time_ago(df: DataFrame, at: str, as_of: Column) -> DataFrame:
    return df.withColumn("time_ago", time_ago(F.col(at), as_of))


def json_metadata_get(df: DataFrame, path: str, out: str, kind: str = "string") -> DataFrame:
    return df.withColumn(out, metadata_get(F.col("metadata"), path, kind))
