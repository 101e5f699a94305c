"""Queries over sources, sinks, validation and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.functions import pii, pricing
from spanmill.functions.spans import span_latency
from spanmill.operators import enrich, validate
from spanmill.plans import derived as d
from spanmill.plans.registry import query
from spanmill.session import work_path, written
from spanmill.sources import batches, tables

_SPAN = """span_id, trace_id, parent_span_id, project_id, name, model, provider, agent_name,
  input_tokens, output_tokens, latency_ms, round(cost_usd, 9) AS cost_usd, status, error_message,
  started_at, ended_at"""
_SPAN_COLUMNS = [
    "span_id", "trace_id", "parent_span_id", "project_id", "name", "model", "provider", "agent_name",
    "input_tokens", "output_tokens", "latency_ms", "cost_usd", "status", "error_message",
    "started_at", "ended_at",
]


@query(
    "read_span_batches",
    "wire",
    """SELECT span_id, batch_id, project_id, input_tokens, replace(metadata, ' ', '') AS metadata
    FROM wire""",
)
def _(spark, sf):
    path = work_path(spark, "envelopes")
    batches.write_envelopes(d.raw_envelopes(spark, sf), path)
    rows = batches.read_span_batches(spark, path)
    get = lambda name, kind="string": F.try_variant_get(f"span.{name}", "$", kind)
    return rows.select(
        get("spanId").alias("span_id"),
        # The batch id itself is a digest of the body; its spans tell the batch.
        F.floor(F.substring(get("spanId"), F.lit(4), F.lit(20)).cast("bigint") / 100)
        .cast("string")
        .alias("batch_id"),
        get("projectId").alias("project_id"),
        get("inputTokens", "int").alias("input_tokens"),
        F.to_json("span.metadata").alias("metadata"),
    )


@query(
    "span_micro_batches",
    "wire",
    """SELECT batch_id, count(*) AS spans, CAST(sum(event_id) AS BIGINT) AS id_sum
    FROM wire GROUP BY batch_id""",
)
def _(spark, sf):
    bodies = batches.envelopes(d.raw_envelopes(spark, sf))
    rows = batches.explode_spans(bodies)
    event = F.expr("CAST(substring(try_variant_get(span.spanId, '$', 'string'), 4) AS BIGINT)")
    return rows.groupBy("batch_id").agg(F.count("*").alias("spans"), F.sum(event).alias("id_sum"))


def _raw(spark, sf):
    return batches.explode_spans(batches.envelopes(d.raw_envelopes(spark, sf)))


@query(
    "validate_spans",
    "wire",
    """SELECT span_id, CASE WHEN reasons = '' THEN trace_id END AS trace_id,
      CASE WHEN reasons = '' THEN project_id END AS project_id,
      CASE WHEN reasons = '' THEN input_tokens END AS input_tokens,
      CASE WHEN reasons = '' THEN latency_ms END AS latency_ms,
      CASE WHEN reasons = '' THEN replace(metadata, ' ', '') END AS metadata,
      CASE WHEN reasons = '' THEN started_at END AS started_at,
      CASE WHEN reasons = '' THEN ended_at END AS ended_at, reasons
    FROM wire""",
)
def _(spark, sf):
    # Checked once, then split: both branches read the checked rows.
    typed = written(validate.typed_spans(_raw(spark, sf)), "typed")
    valid, rejected = validate.split_typed(typed)
    columns = [
        "span_id", "trace_id", "project_id", "input_tokens", "latency_ms", "metadata",
        "started_at", "ended_at",
    ]
    good = valid.select(*columns).withColumn("reasons", F.lit(""))
    bad = rejected.select("span_id", F.array_join("reasons", ",").alias("reasons"))
    return good.unionByName(bad, allowMissingColumns=True)


# At the edge a project id may be any short text, so kind 4 passes there.
@query(
    "validate_batches",
    "wire",
    """SELECT batch_id, count(*) AS n_spans, count(*) FILTER (reasons NOT IN ('', 'projectId')) AS n_bad,
      count(*) FILTER (reasons NOT IN ('', 'projectId')) = 0 AS valid
    FROM wire GROUP BY batch_id""",
)
def _(spark, sf):
    checked = validate.check_batches(batches.envelopes(d.raw_envelopes(spark, sf)))
    return checked.select(
        "batch_id", F.col("n_spans").cast("bigint"), F.col("n_bad").cast("bigint"), "valid"
    )


@query(
    "check_project_match",
    "wire",
    """SELECT batch_id, bool_and(project_id = '00000000-0000-4000-8000-000000000000') AS matches,
      arg_min(span_id, event_id) FILTER (project_id <> '00000000-0000-4000-8000-000000000000')
        AS offending_span_id
    FROM wire GROUP BY batch_id""",
)
def _(spark, sf):
    bodies = batches.envelopes(d.raw_envelopes(spark, sf))
    checked = validate.check_project_match(bodies, d.PROJECT_UUIDS["p0"])
    return checked.select("batch_id", "matches", "offending_span_id")


@query("insert_spans_first_wins", "spans", f"SELECT {_SPAN}, arrival_seq FROM spans")
def _(spark, sf):
    kept = enrich.insert_spans_first_wins(d.duplicates(spark, sf))
    return kept.select(*_SPAN_COLUMNS, "arrival_seq")


@query(
    "index_spans_last_wins",
    "delivered",
    """SELECT span_id, arg_max(coalesce(latency_ms, -1), arrival_seq) AS latency_ms,
      max(arrival_seq) AS arrival_seq, round(arg_max(coalesce(cost_usd, -1e0), arrival_seq), 9) AS cost_usd
    FROM delivered GROUP BY span_id""",
)
def _(spark, sf):
    kept = enrich.index_spans_last_wins(d.duplicates(spark, sf))
    return kept.select(
        "span_id",
        F.coalesce("latency_ms", F.lit(-1)).alias("latency_ms"),
        "arrival_seq",
        F.coalesce("cost_usd", F.lit(-1.0)).alias("cost_usd"),
    )


@query("spans_sink", "spans", f"SELECT {_SPAN}, CAST(started_at AS DATE) AS date FROM spans")
def _(spark, sf):
    path = work_path(spark, "spans")
    batches.spans_sink(d.spans(spark, sf), path)
    return batches.read_spans(spark, path).select(*_SPAN_COLUMNS, "date")


@query(
    "trace_store",
    "traces",
    """SELECT trace_id, project_id, session_id, agent_name, status, total_spans, total_tokens,
      round(total_cost_usd, 9) AS total_cost_usd, total_latency_ms, started_at, ended_at
    FROM traces""",
)
def _(spark, sf):
    # Two batches of partial rows that share traces, read back merged.
    root = work_path(spark, "trace-partials")
    spans = d.spans(spark, sf)
    early = F.col("arrival_seq") % 3 == 0
    tables.write_trace_partials(spans.filter(early), root, 0)
    tables.write_trace_partials(spans.filter(~early), root, 1)
    return tables.read_traces(spark, root).drop("metadata")


@query(
    "legacy_ingest_batch",
    "raw_spans",
    """SELECT span_id AS "spanId", 'p7' AS "projectId", status FROM raw_spans""",
)
def _(spark, sf):
    legacy = d.legacy_spans(spark, sf)
    again = legacy.withColumn("arrival_seq", F.col("arrival_seq") + 10**11).withColumn(
        "status", F.lit("late")
    )
    stored = batches.legacy_ingest_batch(legacy.unionByName(again), "p7")
    return stored.select("spanId", "projectId", "status")


@query(
    "legacy_spans_to_spans",
    "raw_spans",
    """SELECT span_id, trace_id, parent_span_id, name,
      CASE WHEN model IS NULL THEN 'tool' ELSE 'llm' END AS kind, coalesce(latency_ms, 0) AS latency_ms,
      status, error_message, metadata, '[]' AS events, date_trunc('milliseconds', started_at) AS started_at,
      date_trunc('milliseconds', started_at) + coalesce(latency_ms, 0) * INTERVAL 1 MILLISECOND AS ended_at
    FROM raw_spans""",
)
def _(spark, sf):
    return batches.legacy_spans_to_spans(d.legacy_spans(spark, sf)).drop("project_id")


@query(
    "export_csv",
    "text_spans",
    """SELECT span_id, nullif(input, '') AS input, error_message FROM text_spans""",
)
def _(spark, sf):
    path = work_path(spark, "csv")
    batches.export_csv(d.text_spans(spark, sf).select("span_id", "input", "error_message"), path)
    # The header is a row of the first part only.
    rows = spark.read.csv(
        path, quote='"', escape='"', multiLine=True, schema="span_id string, input string, error_message string"
    )
    return rows.filter("span_id <> 'span_id'")


@query(
    "backfill_agent_name",
    "traces",
    """SELECT span_id, coalesce(s.agent_name, t.agent_name) AS agent_name
    FROM spans s LEFT JOIN traces t USING (trace_id)""",
)
def _(spark, sf):
    filled = enrich.backfill_agent_name(d.spans(spark, sf), d.traces(spark, sf))
    return filled.select("span_id", "agent_name")


@query(
    "resolve_agent_name",
    "spans",
    """SELECT s.span_id, CASE WHEN s.agent_name IS NOT NULL THEN s.agent_name
      WHEN s.parent_span_id IS NULL THEN s.name ELSE r.name END AS agent_name
    FROM spans s LEFT JOIN (SELECT trace_id, name FROM spans WHERE parent_span_id IS NULL) r
      USING (trace_id)""",
)
def _(spark, sf):
    return enrich.resolve_agent_name(d.spans(spark, sf)).select("span_id", "agent_name")


_SPACE = r"\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_SQL_RULES = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", rf"(?:\+?1[{_SPACE}.-]?)?\(?\d{{3}}\)?[{_SPACE}.-]?\d{{3}}[{_SPACE}.-]?\d{{4}}\b"),
    # No lookahead there: the forbidden prefixes 000, 666 and 9xx are spelled out.
    (
        "SSN",
        r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d{2}|6[0-57-9]\d|66[0-57-9])[- ]?\d{2}[- ]?\d{4}\b",
    ),
    ("CREDIT_CARD", r"\b(?:\d[ -]?){13,19}\b"),
    ("API_KEY", r"(?i)\b(?:sk|pk|key|api_key|token|secret)[_-]?[A-Za-z0-9]{20,}\b"),
    ("BEARER", rf"(?i)\bBearer[{_SPACE}]+[A-Za-z0-9\-._~+/]+=*\b"),
)


def _sql_redact(column: str, labels: dict[str, str] | None = None, upto: int = 6) -> str:
    for rule, pattern in _SQL_RULES[:upto]:
        label = (labels or {}).get(rule, rule)
        column = f"regexp_replace({column}, '{pattern}', '[REDACTED-{label}]', 'g')"
    return column


@query(
    "scrub_pii",
    "text_spans",
    f"SELECT span_id, {_sql_redact('input')} AS input, {_sql_redact('output')} AS output FROM text_spans",
)
def _(spark, sf):
    return pii.scrub_pii(d.text_spans(spark, sf)).select("span_id", "input", "output")


@query(
    "scrub_pii_sdk",
    "text_spans",
    f"""SELECT span_id, {_sql_redact('input', pii.CLIENT_LABELS)} AS input,
      {_sql_redact('output', pii.CLIENT_LABELS)} AS output FROM text_spans""",
)
def _(spark, sf):
    return pii.scrub_pii_sdk(d.text_spans(spark, sf)).select("span_id", "input", "output")


_SQL_HITS = " UNION ALL ".join(
    f"""SELECT project_id, '{rule}' AS rule, len(regexp_extract_all(t{i}, '{pattern}')) AS n FROM stages"""
    for i, (rule, pattern) in enumerate(_SQL_RULES)
)


@query(
    "pii_report",
    "text_spans",
    f"""WITH stages AS (SELECT project_id, {', '.join(
        f"{_sql_redact('input', None, i)} AS t{i}" for i in range(6))} FROM text_spans),
    hits AS ({_SQL_HITS})
    SELECT project_id, rule, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS rows
    FROM hits GROUP BY project_id, rule""",
)
def _(spark, sf):
    return pii.pii_report(d.text_spans(spark, sf))


@query(
    "price_lookup",
    "spans",
    "SELECT span_id, round(price_in * 1000, 9) AS price_in, round(price_out * 1000, 9) AS price_out FROM spans",
)
def _(spark, sf):
    priced = pricing.price_lookup(d.raw_spans(spark, sf))
    return priced.select(
        "span_id", (F.col("price_in") * 1000).alias("price_in"), (F.col("price_out") * 1000).alias("price_out")
    )


@query("compute_cost", "spans", "SELECT span_id, round(cost_usd, 9) AS cost_usd FROM spans")
def _(spark, sf):
    return pricing.compute_cost(d.raw_spans(spark, sf)).select("span_id", "cost_usd")


def _sql_cost(cases: str, per: str, fallback: str = "NULL") -> str:
    return f"""SELECT span_id, model, round((input_tokens * p[1] + output_tokens * p[2]) / {per}, 9) AS cost_usd
    FROM (SELECT *, CASE {cases} ELSE {fallback} END AS p FROM raw_spans) WHERE true"""


def _cost_query(name: str, build, sql: str) -> None:
    @query(name, "raw_spans", sql)
    def _(spark, sf):
        return build(d.raw_spans(spark, sf)).select("span_id", "model", "cost_usd")


_cost_query(
    "cost_proxy_openai",
    pricing.cost_proxy_openai,
    _sql_cost("model WHEN 'gpt-4o' THEN [0.005e0, 0.015e0]", "1000e0"),
)
_cost_query(
    "cost_proxy_anthropic",
    pricing.cost_proxy_anthropic,
    _sql_cost("WHEN model LIKE 'claude-3-haiku%' THEN [0.25e0, 1.25e0]", "1000000e0"),
)
_cost_query(
    "cost_sdk_openai",
    pricing.cost_sdk_openai,
    _sql_cost("WHEN model IN ('gpt-4o', 'gpt-4o-2099-01-01') THEN [0.005e0, 0.015e0]", "1000e0"),
)
_cost_query(
    "cost_sdk_anthropic_ts",
    pricing.cost_sdk_anthropic_ts,
    _sql_cost("WHEN model LIKE '%claude-3-haiku%' THEN [0.25e0, 1.25e0]", "1000000e0", "[3e0, 15e0]"),
)
_cost_query(
    "cost_sdk_anthropic_py",
    pricing.cost_sdk_anthropic_py,
    _sql_cost("model WHEN 'claude-3-haiku-20240307' THEN [0.00025e0, 0.00125e0]", "1000e0"),
)


@query(
    "pricing_drift",
    "spans",
    """SELECT span_id, round(client_cost, 9) AS client_cost_usd, round(own, 9) AS recomputed_cost_usd,
      round(client_cost - own, 9) AS drift_usd
    FROM (SELECT *, CASE WHEN model IN ('gpt-4o', 'gpt-4o-2099-01-01')
        THEN input_tokens / 1000e0 * 0.005e0 + output_tokens / 1000e0 * 0.015e0 END AS client_cost,
      input_tokens / 1000e0 * price_in + output_tokens / 1000e0 * price_out AS own FROM spans)
    WHERE abs(client_cost - own) > 1e-9""",
)
def _(spark, sf):
    reported = pricing.cost_sdk_openai(d.raw_spans(spark, sf), "client_cost_usd")
    drift = pricing.pricing_drift(reported, "client_cost_usd")
    return drift.select("span_id", "client_cost_usd", "recomputed_cost_usd", "drift_usd")


@query(
    "span_latency",
    "raw_spans",
    """SELECT span_id, CAST(CASE WHEN latency_ms IS NOT NULL THEN latency_ms
      ELSE epoch_us(started_at + INTERVAL 250 MILLISECOND) // 1000 - epoch_us(started_at) // 1000 END AS INT)
      AS latency_ms FROM raw_spans""",
)
def _(spark, sf):
    rows = d.raw_spans(spark, sf).withColumn(
        "ended_at", F.timestamp_micros(F.unix_micros("started_at") + 250_000)
    )
    return rows.select("span_id", span_latency().alias("latency_ms"))


@query(
    "input_preview",
    "text_spans",
    """SELECT trace_id, left(input, 100) AS input_preview FROM text_spans
    WHERE parent_span_id IS NULL AND input IS NOT NULL""",
)
def _(spark, sf):
    return enrich.input_preview(d.text_spans(spark, sf))


@query(
    "parse_chat_messages",
    "calls",
    """SELECT call_id AS span_id, 0 AS position, prev_role AS role, prev_text AS content FROM calls
    WHERE provider = 'openai' AND prev_role IS NOT NULL""",
)
def _(spark, sf):
    # Conversations as inputs: transcripts of the even ones, the plain answer for the rest.
    calls = d.calls(spark, sf)
    inputs = calls.select(
        F.col("call_id").alias("span_id"),
        F.when(F.col("conv_id") % 2 == 0, F.coalesce(F.get_json_object("request_body", "$.messages"), F.col("text")))
        .otherwise(F.col("text")).alias("input"),
    )
    return enrich.parse_chat_messages(inputs)


@query(
    "token_share",
    "spans",
    """SELECT span_id, CASE WHEN t > 0 THEN round(i * 100e0 / t, 9) ELSE 50e0 END AS input_pct,
      CASE WHEN t > 0 THEN round((t - i) * 100e0 / t, 9) ELSE 50e0 END AS output_pct
    FROM (SELECT span_id, coalesce(input_tokens, 0) AS i,
      coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS t FROM spans)""",
)
def _(spark, sf):
    return enrich.with_token_share(d.spans(spark, sf)).select("span_id", "input_pct", "output_pct")


@query(
    "latency_bucket",
    "traces",
    """SELECT latency_bucket, count(*) AS traces FROM (SELECT CASE WHEN total_latency_ms <= 1000 THEN '<1s'
      WHEN total_latency_ms <= 3000 THEN '1-3s' WHEN total_latency_ms <= 5000 THEN '3-5s'
      ELSE '>5s' END AS latency_bucket FROM traces) GROUP BY 1""",
)
def _(spark, sf):
    rows = enrich.with_buckets(d.traces(spark, sf), "total_latency_ms", "total_cost_usd")
    return rows.groupBy("latency_bucket").agg(F.count("*").alias("traces"))


@query(
    "cost_bucket",
    "traces",
    """SELECT cost_bucket, count(*) AS traces FROM (SELECT CASE WHEN total_cost_usd <= 0.01e0 THEN '<0.01'
      WHEN total_cost_usd <= 0.10e0 THEN '0.01-0.10' ELSE '>0.10' END AS cost_bucket FROM traces)
    GROUP BY 1""",
)
def _(spark, sf):
    rows = enrich.with_buckets(d.traces(spark, sf), "total_latency_ms", "total_cost_usd")
    return rows.groupBy("cost_bucket").agg(F.count("*").alias("traces"))


@query(
    "time_ago",
    "spans",
    f"""SELECT span_id, CASE WHEN ms < 10000 THEN 'just now' WHEN ms < 60000 THEN (ms // 1000) || 's ago'
      WHEN ms < 3600000 THEN (ms // 60000) || 'm ago' WHEN ms < 86400000 THEN (ms // 3600000) || 'h ago'
      ELSE (ms // 86400000) || 'd ago' END AS time_ago
    FROM (SELECT span_id, epoch_us(TIMESTAMP '{d.AS_OF}') // 1000 - epoch_us(started_at) // 1000 AS ms FROM spans)""",
)
def _(spark, sf):
    as_of = F.lit(d.AS_OF).cast("timestamp")
    return enrich.with_time_ago(d.spans(spark, sf), "started_at", as_of).select("span_id", "time_ago")


@query(
    "json_metadata_get",
    "spans",
    """SELECT CAST(json_extract_string(metadata, '$.k') AS INT) AS k, count(*) AS spans
    FROM spans GROUP BY 1""",
)
def _(spark, sf):
    rows = enrich.json_metadata_get(d.spans(spark, sf), "$.k", "k", "int")
    return rows.groupBy("k").agg(F.count("*").alias("spans"))
