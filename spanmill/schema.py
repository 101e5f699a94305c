"""Schemas and enumerations of the data model."""

from pyspark.sql import types as T

SPAN_STATUSES = ("success", "error", "timeout")
TRACE_STATUSES = ("running", "success", "error", "timeout")
ALERT_TYPES = ("error_rate", "cost_spike", "latency_p95", "failure")
ALERT_CHANNELS = ("slack", "email", "webhook")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _I, _L, _D, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampType(),
)

SPANS = _struct(
    ("span_id", _S),
    ("trace_id", _S),
    ("parent_span_id", _S),
    ("project_id", _S),
    ("name", _S),
    ("model", _S),
    ("provider", _S),
    ("input", _S),
    ("output", _S),
    ("agent_name", _S),
    ("input_tokens", _I),
    ("output_tokens", _I),
    ("latency_ms", _I),
    ("cost_usd", _D),
    ("status", _S),
    ("error_message", _S),
    ("metadata", _S),
    ("started_at", _TS),
    ("ended_at", _TS),
    ("session_id", _S),
    ("arrival_seq", _L),
)

TRACES = _struct(
    ("trace_id", _S),
    ("project_id", _S),
    ("session_id", _S),
    ("agent_name", _S),
    ("status", _S),
    ("total_spans", _L),
    ("total_tokens", _L),
    ("total_cost_usd", _D),
    ("total_latency_ms", _L),
    ("started_at", _TS),
    ("ended_at", _TS),
    ("metadata", _S),
)

PROJECTS = _struct(
    ("project_id", _S),
    ("name", _S),
    ("retention_days", _I),
    ("monthly_budget_usd", T.DecimalType(10, 2)),
)

ALERTS = _struct(
    ("alert_id", _S),
    ("project_id", _S),
    ("name", _S),
    ("type", _S),
    ("threshold", T.DecimalType(10, 4)),
    ("channel", _S),
    ("channel_config", _S),
    ("is_active", T.BooleanType()),
    ("created_at", _TS),
)

FIRINGS = _struct(
    ("alert_id", _S),
    ("project_id", _S),
    ("alert_name", _S),
    ("alert_type", _S),
    ("current_value", _D),
    ("threshold", T.DecimalType(10, 4)),
    ("channel", _S),
    ("delivery_status", _S),
    ("error_message", _S),
    ("fired_at", _TS),
)

LEGACY_SPANS = _struct(
    ("spanId", _S),
    ("traceId", _S),
    ("parentSpanId", _S),
    ("projectId", _S),
    ("name", _S),
    ("kind", _S),
    ("startTimeMs", _L),
    ("endTimeMs", _L),
    ("durationMs", _I),
    ("status", _S),
    ("statusMessage", _S),
    ("attributes", _S),
    ("events", _S),
)

CALLS = _struct(
    ("call_id", _S),
    ("path", _S),
    ("request_body", _S),
    ("response_body", _S),
    ("http_status", _I),
    ("started_at", _TS),
    ("ended_at", _TS),
    ("headers", T.MapType(_S, _S)),
)
