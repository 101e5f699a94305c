"""Queries over captured provider calls and their streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import call_logs
from spanmill.plans import derived as d
from spanmill.plans.registry import query

# Escapes of JSON text are those of the SQL engine's own writer.
_OPENAI_INPUT = """CASE WHEN prev_role IS NULL THEN '""'
  ELSE CAST(to_json([{'role': prev_role, 'content': prev_text}]) AS VARCHAR) END"""
_ANTHROPIC_INPUT = "CASE WHEN turn % 4 = 1 THEN 'Be brief.' || chr(10) || chr(10) ELSE '' END || coalesce(prev_text, '')"


@query(
    "parse_proxy_path",
    "",
    r"""SELECT page_id, CASE WHEN ok THEN regexp_extract(path, '^/v1/p/([^/]+)/([^/]+)(/.*)$', 1) END AS project_id,
      CASE WHEN ok THEN regexp_extract(path, '^/v1/p/([^/]+)/([^/]+)(/.*)$', 2) END AS provider,
      CASE WHEN ok THEN regexp_extract(path, '^/v1/p/([^/]+)/([^/]+)(/.*)$', 3) END AS upstream_path
    FROM (SELECT *, regexp_matches(path, '^/v1/p/[^/]+/[^/]+/') AS ok
      FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/v1/p' ELSE '/v1/p/acme' END
        || regexp_replace(url, '^https?:/', '') AS path FROM pages))""",
)
def _(spark, sf):
    pages = d.table(spark, sf, "pages")
    prefix = F.when(F.col("page_id") % 4 == 0, "/v1/p").otherwise("/v1/p/acme")
    paths = pages.select(
        "page_id", F.concat(prefix, F.regexp_replace("url", "^https?:/", "")).alias("path")
    )
    return call_logs.parse_proxy_path(paths).drop("path")


@query(
    "extract_openai_calls",
    "calls",
    f"""SELECT call_id, 'gpt-4o' AS model, {_OPENAI_INPUT} AS input, false AS is_streaming,
      CASE WHEN garbled THEN '' ELSE text END AS output,
      CASE WHEN NOT garbled THEN in_tokens END AS input_tokens,
      CASE WHEN NOT garbled THEN out_tokens END AS output_tokens
    FROM calls WHERE provider = 'openai'""",
)
def _(spark, sf):
    calls = call_logs.parse_proxy_path(d.calls(spark, sf)).filter("provider = 'openai'")
    return call_logs.extract_openai_calls(calls).select(
        "call_id", "model", "input", "is_streaming",
        F.coalesce("output", F.lit("")).alias("output"), "input_tokens", "output_tokens",
    )


@query(
    "extract_anthropic_calls",
    "calls",
    f"""SELECT call_id, 'claude-3-haiku-20240307' AS model, {_ANTHROPIC_INPUT} AS input,
      false AS is_streaming, CASE WHEN garbled THEN '' ELSE text END AS output,
      CASE WHEN NOT garbled THEN in_tokens END AS input_tokens,
      CASE WHEN NOT garbled THEN out_tokens END AS output_tokens
    FROM calls WHERE provider = 'anthropic'""",
)
def _(spark, sf):
    calls = call_logs.parse_proxy_path(d.calls(spark, sf)).filter("provider = 'anthropic'")
    return call_logs.extract_anthropic_calls(calls).select(
        "call_id", "model", "input", "is_streaming", "output", "input_tokens", "output_tokens"
    )


_GENERIC_TEXT = """CAST(to_json({'content': [{'type': 'text', 'text': text}],
  'usage': {'input_tokens': in_tokens, 'output_tokens': out_tokens}}) AS VARCHAR)"""


@query(
    "extract_generic_calls",
    "calls",
    f"""SELECT call_id, 'unknown' AS model, json_extract_string(input, '$.messages[0].role') AS role,
      CASE WHEN NOT garbled THEN text END AS answer FROM (SELECT *, CAST(to_json({{
        'messages': [{{'role': prev_role}}]}}) AS VARCHAR) AS input FROM calls WHERE provider = 'other')""",
)
def _(spark, sf):
    # Key order of raw JSON differs between engines, so two of its values are compared.
    calls = call_logs.parse_proxy_path(d.calls(spark, sf)).filter("provider = 'other'")
    return call_logs.extract_generic_calls(calls).select(
        "call_id",
        "model",
        F.get_json_object("input", "$.messages[0].role").alias("role"),
        F.get_json_object("output", "$.content[0].text").alias("answer"),
    )


@query(
    "dispatch_provider",
    "calls",
    f"""SELECT call_id, provider, CASE provider WHEN 'openai' THEN 'gpt-4o' WHEN 'other' THEN 'unknown'
        ELSE 'claude-3-haiku-20240307' END AS model,
      CASE provider WHEN 'openai' THEN {_OPENAI_INPUT} WHEN 'anthropic' THEN {_ANTHROPIC_INPUT} END AS input,
      CASE WHEN NOT garbled AND provider <> 'other' THEN in_tokens END AS input_tokens
    FROM calls""",
)
def _(spark, sf):
    rows = call_logs.dispatch_provider(call_logs.parse_proxy_path(d.calls(spark, sf)))
    known = F.col("provider") != "other"
    return rows.select(
        "call_id", "provider", "model", F.when(known, F.col("input")).alias("input"), "input_tokens"
    )


@query(
    "calls_to_spans",
    "calls",
    f"""SELECT 'span-' || call_id AS span_id,
      CASE WHEN turn % 4 = 1 THEN 'conv-' || conv_id ELSE 'trace-' || call_id END AS trace_id,
      'p' || (conv_id % 3) AS project_id,
      CASE WHEN turn % 4 = 1 THEN 'chat' ELSE provider || '.proxy' END AS name,
      CASE WHEN turn % 4 = 1 THEN 'chat' ELSE provider || '.proxy' END AS agent_name,
      CASE WHEN http_status = 200 AND garbled THEN '<html>busy</html>'
        WHEN http_status = 200 AND provider <> 'other' THEN text END AS output,
      CASE WHEN usable THEN in_tokens END AS input_tokens, CASE WHEN usable THEN out_tokens END AS output_tokens,
      round(CASE WHEN usable AND provider = 'openai' THEN in_tokens / 1000e0 * 0.005e0 + out_tokens / 1000e0 * 0.015e0
        WHEN usable AND provider = 'anthropic' THEN (in_tokens * 0.25e0 + out_tokens * 1.25e0) / 1000000e0 END, 9)
        AS cost_usd,
      CAST(length(text) AS INT) AS latency_ms, CASE WHEN http_status = 200 THEN 'success' ELSE 'error' END AS status,
      CASE WHEN http_status <> 200 THEN 'Upstream returned 429' END AS error_message, '{{}}' AS metadata
    FROM (SELECT *, http_status = 200 AND NOT garbled AND provider <> 'other' AS usable FROM calls)""",
)
def _(spark, sf):
    rows = call_logs.calls_to_spans(call_logs.parse_proxy_path(d.calls(spark, sf)))
    shown = (F.col("status") == "success") & (
        (F.col("provider") != "other") | F.col("output").startswith("<")
    )
    return rows.select(
        "span_id", "trace_id", "project_id", "name", "agent_name", F.when(shown, F.col("output")).alias("output"),
        "input_tokens", "output_tokens", "cost_usd", "latency_ms", "status", "error_message", "metadata",
    )


@query(
    "calls_to_spans_streamed",
    "calls",
    """SELECT 'span-' || call_id AS span_id, text AS output, 11 AS input_tokens, out_tokens AS output_tokens,
      CASE WHEN http_status = 200 THEN 'success' ELSE 'error' END AS status, NULL::VARCHAR AS error_message,
      '{}' AS metadata FROM calls WHERE provider = 'openai'""",
)
def _(spark, sf):
    calls = call_logs.parse_proxy_path(d.calls(spark, sf)).filter("provider = 'openai'")
    data = call_logs.sse_data_lines(d.openai_lines(spark, sf))
    rows = call_logs.calls_to_spans(calls, call_logs.assemble_sse_openai(data))
    return rows.select(
        "span_id", "output", "input_tokens", "output_tokens", "status", "error_message", "metadata"
    )


@query(
    "assemble_sse_openai",
    "calls",
    """SELECT call_id, text AS output, 11 AS input_tokens, out_tokens AS output_tokens, false AS truncated
    FROM calls""",
)
def _(spark, sf):
    return call_logs.assemble_sse_openai(call_logs.sse_data_lines(d.openai_lines(spark, sf)))


@query(
    "assemble_sse_anthropic",
    "calls",
    """SELECT call_id, text AS output, 10 AS input_tokens, out_tokens AS output_tokens, false AS truncated
    FROM calls""",
)
def _(spark, sf):
    return call_logs.assemble_sse_anthropic(call_logs.sse_data_lines(d.anthropic_lines(spark, sf)))


_WORDS = r"""words AS (SELECT call_id,
    list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM calls)"""


@query(
    "assemble_sse_generic",
    "calls",
    f"""WITH {_WORDS} SELECT call_id, array_to_string(w, chr(10)) AS output, false AS truncated FROM words
    WHERE len(w) > 0""",
)
def _(spark, sf):
    return call_logs.assemble_sse_generic(call_logs.sse_data_lines(d.generic_lines(spark, sf)))


@query(
    "sse_data_lines",
    "calls",
    f"""WITH {_WORDS}, lines AS (SELECT call_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS seq FROM words),
    sized AS (SELECT *, sum(strlen('data: ' || word) + 1) OVER (PARTITION BY call_id ORDER BY seq) AS upto,
      sum(strlen('data: ' || word) + 1) OVER (PARTITION BY call_id) AS total FROM lines)
    SELECT call_id, total > 400 AS truncated, CAST(seq AS INT) AS seq, word AS payload FROM sized WHERE upto <= 400""",
)
def _(spark, sf):
    data = call_logs.sse_data_lines(d.generic_lines(spark, sf), limit=400)
    return data.filter("payload IS NOT NULL")
