"""Spans, calls and dimensions derived from the star-schema test tables.

Spark and SQL forms of the same recipes: each ``SQL_*`` text defines, as a common
table expression for the checking engine, what the function next to it returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.functions.pricing import compute_cost
from spanmill.operators.rollup import finish_traces, trace_partials
from spanmill.session import written
from spanmill.sources.batches import envelope_bodies, wire_span

AS_OF = "2024-01-30 00:00:00"
START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
PROJECT_UUIDS = {
    "p0": "00000000-0000-4000-8000-000000000000",
    "p1": "00000000-0000-4000-8000-000000000001",
    "p2": "00000000-0000-4000-8000-000000000002",
}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A source table; ``spread`` is for work that is heavy per row: the test tables are
    single files, each read by one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.hint("rebalance") if spread else df


def _case(value: Column, branches: dict, default=None) -> Column:
    picked = None
    for key, result in branches.items():
        picked = F.when(value == key, result) if picked is None else picked.when(value == key, result)
    return picked.otherwise(default)


_ROOT_NAME = """CASE (event_id - event_id % 4) % 20 WHEN 0 THEN 'support-agent' WHEN 4 THEN 'review-agent'
  WHEN 8 THEN 'extract-agent' WHEN 12 THEN 'email-agent' ELSE 'planner' END"""
_EVENT_COLUMNS = (
    "concat('sp-', event_id) AS span_id",
    "concat('tr-', event_id - event_id % 4) AS trace_id",
    """CASE event_id % 4 WHEN 0 THEN NULL WHEN 2 THEN concat('sp-', event_id - 1)
      ELSE concat('sp-', event_id - event_id % 4) END AS parent_span_id""",
    "CASE (event_id - event_id % 4) % 12 WHEN 0 THEN 'p0' WHEN 4 THEN 'p1' ELSE 'p2' END AS project_id",
    f"""CASE event_id % 4 WHEN 0 THEN {_ROOT_NAME} WHEN 1 THEN 'retrieve-context'
      WHEN 2 THEN 'generate-response' ELSE 'validate-output' END AS name""",
    """CASE WHEN event_id % 4 <> 1 THEN CASE event_id % 7 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'GPT-4o-mini'
      WHEN 2 THEN 'claude-3-haiku-20240307' WHEN 3 THEN 'gpt-4o-2099-01-01' WHEN 4 THEN 'llama3'
      WHEN 5 THEN 'gpt-99-unknown' ELSE 'gemini-1.5-pro' END END AS model""",
    """CASE WHEN event_id % 4 <> 1 THEN CASE event_id % 7 WHEN 2 THEN 'anthropic' WHEN 4 THEN 'ollama'
      WHEN 6 THEN 'google' ELSE 'openai' END END AS provider""",
    "CAST(NULL AS STRING) AS input",
    "CAST(NULL AS STRING) AS output",
    f"CASE WHEN event_id % 19 <> 0 THEN {_ROOT_NAME} END AS agent_name",
    "CASE WHEN event_id % 4 <> 1 THEN CAST(200 + (event_id * 37) % 1800 AS INT) END AS input_tokens",
    """CASE WHEN event_id % 4 <> 1 AND event_type <> 'error' THEN CAST(50 + (event_id * 53) % 750 AS INT)
      END AS output_tokens""",
    "CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value * 40D) AS INT) END AS latency_ms",
    "CASE WHEN event_id % 23 = 0 THEN 0.042D END AS cost_usd",
    """CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' AND value > 100 THEN 'timeout'
      ELSE 'success' END AS status""",
    """CASE WHEN event_type = 'error' AND event_id % 13 <> 0 THEN CASE event_id % 5
      WHEN 0 THEN 'Rate limit exceeded' WHEN 1 THEN 'Context length exceeded'
      WHEN 2 THEN concat('Connection timeout after ', 1000 * (1 + event_id % 3), 'ms')
      WHEN 3 THEN 'Invalid API key provided' ELSE 'Model overloaded' END END AS error_message""",
    "props AS metadata",
    "CAST(ts AS TIMESTAMP) AS started_at",
    """timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP))
      + CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value * 40D) AS BIGINT) END * 1000) AS ended_at""",
    "CASE WHEN event_id % 4 = 0 THEN concat('s-', user_id) END AS session_id",
    "event_id AS arrival_seq",
)


def events_as_spans(events: DataFrame) -> DataFrame:
    """Spans of the events; ``cost_usd`` is the reported cost. Works on a stream too."""
    return events.selectExpr(*_EVENT_COLUMNS)


SQL_RAW_SPANS = """raw_spans AS (
  SELECT *, CASE WHEN lat IS NOT NULL THEN started_at + lat * INTERVAL 1 MILLISECOND END AS ended_at,
    lat AS latency_ms
  FROM (
    SELECT 'sp-' || event_id AS span_id,
      'tr-' || (event_id - event_id % 4) AS trace_id,
      CASE event_id % 4 WHEN 0 THEN NULL WHEN 2 THEN 'sp-' || (event_id - 1)
        ELSE 'sp-' || (event_id - event_id % 4) END AS parent_span_id,
      CASE (event_id - event_id % 4) % 12 WHEN 0 THEN 'p0' WHEN 4 THEN 'p1' ELSE 'p2' END AS project_id,
      CASE event_id % 4 WHEN 0 THEN root_name WHEN 1 THEN 'retrieve-context'
        WHEN 2 THEN 'generate-response' ELSE 'validate-output' END AS name,
      CASE WHEN event_id % 4 <> 1 THEN CASE event_id % 7 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'GPT-4o-mini'
        WHEN 2 THEN 'claude-3-haiku-20240307' WHEN 3 THEN 'gpt-4o-2099-01-01' WHEN 4 THEN 'llama3'
        WHEN 5 THEN 'gpt-99-unknown' ELSE 'gemini-1.5-pro' END END AS model,
      CASE WHEN event_id % 4 <> 1 THEN CASE event_id % 7 WHEN 2 THEN 'anthropic' WHEN 4 THEN 'ollama'
        WHEN 6 THEN 'google' ELSE 'openai' END END AS provider,
      CASE WHEN event_id % 19 <> 0 THEN root_name END AS agent_name,
      CASE WHEN event_id % 4 <> 1 THEN CAST(200 + (event_id * 37) % 1800 AS INT) END AS input_tokens,
      CASE WHEN event_id % 4 <> 1 AND event_type <> 'error'
        THEN CAST(50 + (event_id * 53) % 750 AS INT) END AS output_tokens,
      CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value * 40e0) AS INT) END AS lat,
      CASE WHEN event_id % 23 = 0 THEN 0.042e0 END AS reported_cost_usd,
      CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' AND value > 100 THEN 'timeout'
        ELSE 'success' END AS status,
      CASE WHEN event_type = 'error' AND event_id % 13 <> 0 THEN CASE event_id % 5
        WHEN 0 THEN 'Rate limit exceeded' WHEN 1 THEN 'Context length exceeded'
        WHEN 2 THEN 'Connection timeout after ' || (1000 * (1 + event_id % 3)) || 'ms'
        WHEN 3 THEN 'Invalid API key provided' ELSE 'Model overloaded' END END AS error_message,
      props AS metadata, ts AS started_at,
      CASE WHEN event_id % 4 = 0 THEN 's-' || user_id END AS session_id,
      event_id AS arrival_seq, event_id
    FROM (SELECT *, CASE (event_id - event_id % 4) % 20 WHEN 0 THEN 'support-agent'
      WHEN 4 THEN 'review-agent' WHEN 8 THEN 'extract-agent' WHEN 12 THEN 'email-agent'
      ELSE 'planner' END AS root_name FROM events)))"""

SQL_SPANS = """spans AS (
  SELECT *, COALESCE(CASE WHEN model IS NOT NULL AND price_in IS NOT NULL
      THEN input_tokens / 1000e0 * price_in + output_tokens / 1000e0 * price_out END,
    reported_cost_usd) AS cost_usd
  FROM (SELECT *,
    CASE model WHEN 'gpt-4o' THEN 0.0025e0 WHEN 'GPT-4o-mini' THEN 0.00015e0
      WHEN 'claude-3-haiku-20240307' THEN 0.00025e0 WHEN 'gpt-4o-2099-01-01' THEN 0.0025e0
      WHEN 'llama3' THEN 0e0 WHEN 'gemini-1.5-pro' THEN 0.00125e0 END AS price_in,
    CASE model WHEN 'gpt-4o' THEN 0.01e0 WHEN 'GPT-4o-mini' THEN 0.0006e0
      WHEN 'claude-3-haiku-20240307' THEN 0.00125e0 WHEN 'gpt-4o-2099-01-01' THEN 0.01e0
      WHEN 'llama3' THEN 0e0 WHEN 'gemini-1.5-pro' THEN 0.005e0 END AS price_out
    FROM raw_spans))"""

SQL_TRACES = """traces AS (
  SELECT trace_id, arg_min(project_id, arrival_seq) AS project_id,
    arg_min(session_id, arrival_seq) FILTER (session_id IS NOT NULL) AS session_id,
    arg_min(name, arrival_seq) FILTER (parent_span_id IS NULL) AS agent_name,
    CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'timeout') THEN 'timeout'
      ELSE 'success' END AS status,
    count(*) AS total_spans,
    CAST(sum(COALESCE(input_tokens, 0) + COALESCE(output_tokens, 0)) AS BIGINT) AS total_tokens,
    sum(COALESCE(cost_usd, 0e0)) AS total_cost_usd,
    CAST(sum(COALESCE(latency_ms, 0)) AS BIGINT) AS total_latency_ms,
    arg_min(started_at, arrival_seq) AS started_at,
    arg_max(ended_at, arrival_seq) FILTER (ended_at IS NOT NULL) AS ended_at,
    arg_min(metadata, arrival_seq) AS metadata
  FROM spans GROUP BY trace_id)"""


def raw_spans(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return events_as_spans(table(spark, sf_dir, "events", spread))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_cost(raw_spans(spark, sf_dir))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish_traces(trace_partials(spans(spark, sf_dir)))


def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per document, in traces of three, with its whole text."""
    n = F.col("doc_id")
    g = n - n % 3
    doc = lambda e: F.concat(F.lit("doc-"), e.cast("string"))
    root = n % 3 == 0
    return table(spark, sf_dir, "documents", spread=True).select(
        doc(n).alias("span_id"),
        F.concat(F.lit("dt-"), g.cast("string")).alias("trace_id"),
        F.when(~root, doc(g)).alias("parent_span_id"),
        F.concat(F.lit("p"), ((g % 9) / 3).cast("int").cast("string")).alias("project_id"),
        F.concat(F.when(root, "writer-").otherwise("step-"), F.col("lang")).alias("name"),
        F.lit("gpt-4o").alias("model"),
        F.lit("openai").alias("provider"),
        F.col("text").alias("input"),
        F.when(n % 4 == 1, F.col("text")).alias("output"),
        F.when(n % 7 == 0, "error").otherwise("success").alias("status"),
        F.when(n % 14 == 0, "Model overloaded").alias("error_message"),
        F.timestamp_seconds(F.unix_seconds(F.lit(START).cast("timestamp")) + n * 60).alias("started_at"),
        n.alias("arrival_seq"),
    )


SQL_TEXT_SPANS = """text_spans AS (
  SELECT 'doc-' || doc_id AS span_id, 'dt-' || (doc_id - doc_id % 3) AS trace_id,
    CASE WHEN doc_id % 3 <> 0 THEN 'doc-' || (doc_id - doc_id % 3) END AS parent_span_id,
    'p' || (((doc_id - doc_id % 3) % 9) // 3) AS project_id,
    CASE WHEN doc_id % 3 = 0 THEN 'writer-' ELSE 'step-' END || lang AS name,
    'gpt-4o' AS model, 'openai' AS provider, text AS input,
    CASE WHEN doc_id % 4 = 1 THEN text END AS output,
    CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'success' END AS status,
    CASE WHEN doc_id % 14 = 0 THEN 'Model overloaded' END AS error_message,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS started_at,
    doc_id AS arrival_seq
  FROM documents)"""


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 31st span delivered again later, with another latency."""
    once = spans(spark, sf_dir)
    again = (
        once.filter(F.col("arrival_seq") % 31 == 0)
        .withColumn("arrival_seq", F.col("arrival_seq") + 100_000_000_000)
        .withColumn("latency_ms", F.lit(7))
    )
    return once.unionByName(again)


SQL_DELIVERED = """delivered AS (
  SELECT * FROM spans
  UNION ALL
  SELECT * REPLACE (arrival_seq + 100000000000 AS arrival_seq, 7 AS latency_ms)
  FROM spans WHERE arrival_seq % 31 = 0)"""


def projects(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """SELECT * FROM VALUES
        ('p0', 'Support', 7, CAST(5.00 AS DECIMAL(10,2))),
        ('p1', 'Review', 15, CAST(50.00 AS DECIMAL(10,2))),
        ('p2', 'Mail', 30, CAST(NULL AS DECIMAL(10,2))),
        ('p3', 'Empty', NULL, CAST(1.00 AS DECIMAL(10,2)))
        AS t(project_id, name, retention_days, monthly_budget_usd)"""
    )


SQL_PROJECTS = """projects AS (
  SELECT * FROM (VALUES ('p0', 'Support', 7, 5.00e0), ('p1', 'Review', 15, 50.00e0),
    ('p2', 'Mail', 30, NULL), ('p3', 'Empty', NULL, 1.00e0))
  AS t(project_id, name, retention_days, monthly_budget_usd))"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per supplier; project p3 has no spans and some alerts are inactive."""
    n = F.col("s_suppkey")
    kind = _case(n % 4, {0: "error_rate", 1: "cost_spike", 2: "latency_p95"}, "failure")
    scale = _case(n % 4, {0: 100.0, 1: 1e6, 2: 2.0}, 5000.0)
    channel = _case(n % 3, {0: "slack", 1: "email"}, "webhook")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("al-"), n.cast("string")).alias("alert_id"),
        F.concat(F.lit("p"), (F.floor(n / 4) % 4).cast("string")).alias("project_id"),
        F.col("s_name").alias("name"),
        kind.alias("type"),
        F.round(F.abs("s_acctbal") / scale, 4).cast("decimal(10,4)").alias("threshold"),
        channel.alias("channel"),
        F.lit("{}").alias("channel_config"),
        (n % 5 != 0).alias("is_active"),
        F.timestamp_seconds(
            F.unix_seconds(F.lit(START).cast("timestamp")) + (n * 7919) % 100_000
        ).alias("created_at"),
    )


SQL_ALERTS = """alerts AS (
  SELECT 'al-' || s_suppkey AS alert_id, 'p' || ((s_suppkey // 4) % 4) AS project_id, s_name AS name,
    CASE s_suppkey % 4 WHEN 0 THEN 'error_rate' WHEN 1 THEN 'cost_spike' WHEN 2 THEN 'latency_p95'
      ELSE 'failure' END AS type,
    CAST(round(abs(s_acctbal) / CASE s_suppkey % 4 WHEN 0 THEN 100e0 WHEN 1 THEN 1e6 WHEN 2 THEN 2e0
      ELSE 5000e0 END, 4) AS DECIMAL(10,4)) AS threshold,
    CASE s_suppkey % 3 WHEN 0 THEN 'slack' WHEN 1 THEN 'email' ELSE 'webhook' END AS channel,
    s_suppkey % 5 <> 0 AS is_active,
    TIMESTAMP '2024-01-01 00:00:00' + ((s_suppkey * 7919) % 100000) * INTERVAL 1 SECOND AS created_at
  FROM supplier)"""


def firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored firings made from the orders."""
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("fi-"), n.cast("string")).alias("firing_id"),
        F.concat(F.lit("al-"), (n % 50).cast("string")).alias("alert_id"),
        F.concat(F.lit("p"), (n % 4).cast("string")).alias("project_id"),
        (F.col("o_totalprice") / 1000).alias("current_value"),
        F.timestamp_seconds(
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + n % 86_400
        ).alias("fired_at"),
    )


SQL_FIRINGS = """firings AS (
  SELECT 'fi-' || o_orderkey AS firing_id, 'al-' || (o_orderkey % 50) AS alert_id,
    'p' || (o_orderkey % 4) AS project_id, o_totalprice / 1000 AS current_value,
    o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND AS fired_at
  FROM orders)"""


def wire_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as wire JSON (arrival_seq, _json); every 29th one breaks a rule."""
    n = F.col("arrival_seq")
    broken = lambda kind: (n % 29 == 0) & (n % 5 == kind)
    rows = raw_spans(spark, sf_dir, spread=True).drop("input", "output")
    rows = rows.withColumns(
        {
            "status": F.when(broken(0), "running").otherwise(F.col("status")),
            "input_tokens": F.when(broken(1), -1).otherwise(F.col("input_tokens")),
            "name": F.when(broken(2), "").otherwise(F.col("name")),
            "project_id": F.when(broken(4), "nope").otherwise(
                _case(F.col("project_id"), PROJECT_UUIDS)
            ),
        }
    )
    text = F.to_json(wire_span(rows.columns))
    bad_date = F.regexp_replace(text, '"startedAt":"', '"startedAt":"on ')
    return rows.select("arrival_seq", F.when(broken(3), bad_date).otherwise(text).alias("_json"))


def raw_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = envelope_bodies(wire_rows(spark, sf_dir))
    # Many source files, as many senders would leave; gzip files are read whole by one task.
    return bodies.repartition(spark.sparkContext.defaultParallelism)


SQL_WIRE = """wire AS (
  SELECT * REPLACE (
      CASE WHEN kind = 0 THEN 'running' ELSE status END AS status,
      CASE WHEN kind = 1 THEN -1 ELSE input_tokens END AS input_tokens,
      CASE WHEN kind = 2 THEN '' ELSE name END AS name,
      CASE WHEN kind = 4 THEN 'nope' ELSE '00000000-0000-4000-8000-00000000000' || right(project_id, 1)
        END AS project_id),
    CASE kind WHEN 0 THEN 'status' WHEN 1 THEN 'inputTokens' WHEN 2 THEN 'name' WHEN 3 THEN 'startedAt'
      WHEN 4 THEN 'projectId' ELSE '' END AS reasons,
    CAST(event_id // 100 AS VARCHAR) AS batch_id
  FROM (SELECT *, CASE WHEN event_id % 29 = 0 THEN event_id % 5 END AS kind FROM raw_spans))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per assistant turn: OpenAI shape for even conversations, else Anthropic."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = (
        table(spark, sf_dir, "conversations")
        .withColumn("prev_role", F.lag("role").over(order))
        .withColumn("prev_text", F.lag("text").over(order))
        .filter("role = 'assistant'")
    )
    c, t = F.col("conv_id"), F.col("turn")
    openai = c % 2 == 0
    provider = F.when(openai, "openai").when(c % 3 == 0, "other").otherwise("anthropic")
    plain = F.struct(F.col("prev_role").alias("role"), F.col("prev_text").alias("content"))
    block = F.struct(F.lit("text").alias("type"), F.col("prev_text").alias("text"))
    blocks = F.struct(F.col("prev_role").alias("role"), F.array(block).alias("content"))
    has_prev = F.col("prev_role").isNotNull()
    openai_req = F.to_json(
        F.struct(F.lit("gpt-4o").alias("model"), F.when(has_prev, F.array(plain)).alias("messages"))
    )
    anthropic_req = F.when(
        t % 4 == 1,
        F.to_json(
            F.struct(
                F.lit("claude-3-haiku-20240307").alias("model"),
                F.lit("Be brief.").alias("system"),
                F.when(has_prev, F.array(plain)).alias("messages"),
            )
        ),
    ).otherwise(
        F.to_json(
            F.struct(
                F.lit("claude-3-haiku-20240307").alias("model"),
                F.when(has_prev, F.array(blocks)).alias("messages"),
            )
        )
    )
    in_tokens = F.floor(F.length("prev_text") / 4).cast("int")
    out_tokens = F.floor(F.length("text") / 4).cast("int")
    openai_res = F.to_json(
        F.struct(
            F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"),
            F.struct(in_tokens.alias("prompt_tokens"), out_tokens.alias("completion_tokens")).alias(
                "usage"
            ),
        )
    )
    anthropic_res = F.to_json(
        F.struct(
            F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"),
            F.struct(in_tokens.alias("input_tokens"), out_tokens.alias("output_tokens")).alias("usage"),
        )
    )
    started = F.timestamp_seconds(F.unix_seconds(F.lit(START).cast("timestamp")) + c * 60 + t)
    return turns.select(
        F.concat_ws("-", F.lit("call"), c, t).alias("call_id"),
        F.concat(F.lit("/v1/p/p"), c % 3, F.lit("/"), provider, F.lit("/v1/chat")).alias("path"),
        F.when(openai, openai_req).otherwise(anthropic_req).alias("request_body"),
        F.when(c % 11 == 5, "<html>busy</html>")
        .when(openai, openai_res)
        .otherwise(anthropic_res)
        .alias("response_body"),
        F.when(c % 7 == 3, 429).otherwise(200).alias("http_status"),
        started.alias("started_at"),
        F.timestamp_millis(F.unix_millis(started) + F.length("text")).alias("ended_at"),
        F.when(
            t % 4 == 1,
            F.create_map(
                F.lit("x-trace-trace-id"),
                F.concat(F.lit("conv-"), c.cast("string")),
                F.lit("x-trace-span-name"),
                F.lit("chat"),
            ),
        )
        .otherwise(F.create_map(F.lit("accept"), F.lit("*/*")))
        .alias("headers"),
        "conv_id",
        "turn",
        "text",
    )


SQL_CALLS = """calls AS (
  SELECT *, 'call-' || conv_id || '-' || turn AS call_id,
    CASE WHEN conv_id % 2 = 0 THEN 'openai' WHEN conv_id % 3 = 0 THEN 'other' ELSE 'anthropic'
      END AS provider,
    CAST(length(prev_text) // 4 AS INT) AS in_tokens, CAST(length(text) // 4 AS INT) AS out_tokens,
    TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60 + turn) * INTERVAL 1 SECOND AS started_at,
    conv_id % 11 = 5 AS garbled, CASE WHEN conv_id % 7 = 3 THEN 429 ELSE 200 END AS http_status
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
      lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text FROM conversations)
  WHERE role = 'assistant')"""


def _lines(calls_df: DataFrame, head: list[Column], delta, tail: list[Column]) -> DataFrame:
    """Stream lines of each call: head, one delta per word, tail; blank and noise lines too."""
    words = F.split("text", " ", -1)
    deltas = F.transform(
        words, lambda w, i: delta(F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)))
    )
    noise = [F.lit("event: ping"), F.lit(""), F.lit("data: {oops")]
    lines = F.concat(F.array(*noise, *head), deltas, F.array(*tail))
    rows = _spread(calls_df).select("call_id", F.posexplode(lines).alias("seq", "line"))
    # Captured lines are a table: the jobs over them read it more than once.
    return written(rows, "stream-lines")


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before per-row work, as the small test tables fill one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _data(doc: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(doc), F.lit("  "))


def openai_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def delta(word: Column) -> Column:
        content = F.struct(F.struct(word.alias("content")).alias("delta"))
        return _data(F.struct(F.array(content).alias("choices")))

    n = F.floor(F.length("text") / 4).cast("int")
    usage = F.struct(F.lit(11).alias("prompt_tokens"), n.alias("completion_tokens"))
    tail = [_data(F.struct(usage.alias("usage"))), F.lit("data: [DONE]"), delta(F.lit("late"))]
    return _lines(calls(spark, sf_dir), [], delta, tail)


def anthropic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def delta(word: Column) -> Column:
        inner = F.struct(F.lit("text_delta").alias("type"), word.alias("text"))
        return _data(F.struct(F.lit("content_block_delta").alias("type"), inner.alias("delta")))

    n = F.floor(F.length("text") / 4).cast("int")
    start = F.struct(F.struct(F.lit(10).alias("input_tokens")).alias("usage"))
    head = [_data(F.struct(F.lit("message_start").alias("type"), start.alias("message")))]
    end = F.struct(n.alias("output_tokens"))
    tail = [_data(F.struct(F.lit("message_delta").alias("type"), end.alias("usage")))]
    return _lines(calls(spark, sf_dir), head, delta, tail)


def generic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as plain payloads (line breaks become spaces)."""
    flat = calls(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    words = F.transform(
        F.filter(F.split("text", " ", -1), lambda w: w != ""), lambda w: F.concat(F.lit("data: "), w)
    )
    return flat.select("call_id", F.posexplode(words).alias("seq", "line"))


def legacy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in the legacy schema."""
    rows = raw_spans(spark, sf_dir)
    start = F.unix_millis("started_at")
    duration = F.coalesce("latency_ms", F.lit(0))
    return rows.select(
        F.col("span_id").alias("spanId"),
        F.col("trace_id").alias("traceId"),
        F.col("parent_span_id").alias("parentSpanId"),
        F.lit(None).cast("string").alias("projectId"),
        "name",
        F.when(F.col("model").isNull(), "tool").otherwise("llm").alias("kind"),
        start.alias("startTimeMs"),
        (start + duration).alias("endTimeMs"),
        duration.alias("durationMs"),
        "status",
        F.col("error_message").alias("statusMessage"),
        F.col("metadata").alias("attributes"),
        F.lit(None).cast("string").alias("events"),
        "arrival_seq",
    )


_CTES = {
    "raw_spans": (SQL_RAW_SPANS, ()),
    "spans": (SQL_SPANS, ("raw_spans",)),
    "traces": (SQL_TRACES, ("raw_spans", "spans")),
    "text_spans": (SQL_TEXT_SPANS, ()),
    "delivered": (SQL_DELIVERED, ("raw_spans", "spans")),
    "projects": (SQL_PROJECTS, ()),
    "alerts": (SQL_ALERTS, ()),
    "firings": (SQL_FIRINGS, ()),
    "wire": (SQL_WIRE, ("raw_spans",)),
    "calls": (SQL_CALLS, ()),
}


def with_tables(names: str, body: str) -> str:
    """``body`` after the common table expressions it names (space separated)."""
    wanted: list[str] = []
    for name in names.split():
        for needed in (*_CTES[name][1], name):
            if needed not in wanted:
                wanted.append(needed)
    body = body.strip()
    parts = ",\n".join(_CTES[n][0] for n in wanted)
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts},\n{body[len('WITH RECURSIVE '):]}"
    if body.startswith("WITH "):
        return f"WITH {parts},\n{body[len('WITH '):]}"
    return f"WITH {parts}\n{body}"
