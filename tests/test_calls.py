"""Captured calls: golden request, response and stream bodies."""

import json

from pyspark.sql import functions as F

from spanmill.operators import call_logs as c

SCHEMA = """call_id string, path string, request_body string, response_body string, http_status int,
  started string, ended string, headers map<string,string>"""


def calls(spark, *rows):
    full = [
        (f"c{i}", path, req, res, status, "2024-01-01 00:00:00", "2024-01-01 00:00:01.5", headers)
        for i, (path, req, res, status, headers) in enumerate(rows)
    ]
    df = spark.createDataFrame(full, SCHEMA)
    df = df.withColumn("started_at", F.col("started").cast("timestamp")).withColumn(
        "ended_at", F.col("ended").cast("timestamp")
    )
    return c.parse_proxy_path(df)


def test_paths(spark):
    paths = {
        "/v1/p/acme/openai/v1/chat": ("acme", "openai", "/v1/chat"),
        "/v1/p/acme/openai/": ("acme", "openai", "/"),
        "/v1/p/acme/openai": (None, None, None),
        "/v1/p//openai/x": (None, None, None),
        "/v2/p/acme/openai/x": (None, None, None),
        "/v1/p/acme//x": (None, None, None),
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for r in c.parse_proxy_path(df).collect():
        assert (r["project_id"], r["provider"], r["upstream_path"]) == paths[r["path"]]


OPENAI = "/v1/p/p/openai/v1/chat"
ANTHROPIC = "/v1/p/p/anthropic/v1/messages"


def test_openai(spark):
    req = {"model": "gpt-4o", "messages": [{"role": "user", "content": "Hi"}], "stream": True}
    res = {
        "choices": [{"message": {"role": "assistant", "content": "Hello"}}],
        "usage": {"prompt_tokens": 10, "completion_tokens": 5},
    }
    df = calls(
        spark,
        (OPENAI, json.dumps(req), json.dumps(res), 200, {}),
        (OPENAI, '{"prompt":"Say"}', '{"choices":[]}', 200, {}),
        (OPENAI, "{}", '{"choices":[{"message":{"content":null}}],"usage":{}}', 200, {}),
    )
    first, prompt, empty = c.extract_openai_calls(df).orderBy("call_id").collect()
    assert first["input"] == '[{"role":"user","content":"Hi"}]' and first["is_streaming"]
    assert (first["model"], first["output"]) == ("gpt-4o", "Hello")
    assert (first["input_tokens"], first["output_tokens"]) == (10, 5)
    assert (prompt["model"], prompt["input"], prompt["output"]) == ("unknown", '"Say"', "")
    assert (empty["input"], empty["output"], empty["is_streaming"]) == ('""', "", False)


def test_anthropic(spark):
    req = {
        "model": "claude-3-haiku-20240307",
        "system": "You are kind.",
        "messages": [
            {"role": "user", "content": "Hi"},
            {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]},
            {"role": "user", "content": 5},
        ],
    }
    res = {
        "content": [{"type": "text", "text": "Hel"}, {"type": "tool_use"}, {"type": "text", "text": "lo"}],
        "usage": {"input_tokens": 7, "output_tokens": 3},
    }
    row = c.extract_anthropic_calls(calls(spark, (ANTHROPIC, json.dumps(req), json.dumps(res), 200, {}))).first()
    assert row["input"] == "You are kind.\n\nHi\nab\n" and row["output"] == "Hello"
    assert (row["input_tokens"], row["output_tokens"]) == (7, 3)


def test_spans_of_calls(spark):
    ok = json.dumps({"choices": [{"message": {"content": "x"}}], "usage": {"prompt_tokens": 1000, "completion_tokens": 1000}})
    body = '{"model":"gpt-4o","messages":[]}'
    headers = {"x-trace-trace-id": "t", "x-trace-parent-span-id": "par", "x-trace-span-name": "nm"}
    df = calls(
        spark,
        (OPENAI, body, ok, 200, headers),
        (OPENAI, body, "<oops>", 200, {}),
        (OPENAI, body, "slow down", 429, {}),
        (OPENAI, body, None, None, {}),
        ("/v1/p/p/other/x", '{"z":1,"a":2}', '{"b": 1}', 200, {}),
    ).withColumn("transport_error", F.when(F.col("http_status").isNull(), "unreachable"))
    a, b, e, n, g = c.calls_to_spans(df).orderBy("span_id").collect()
    assert (a["trace_id"], a["parent_span_id"], a["name"], a["agent_name"]) == ("t", "par", "nm", "nm")
    assert a["cost_usd"] == 0.02 and a["latency_ms"] == 1500 and a["status"] == "success"
    assert (b["output"], b["status"], b["input_tokens"], b["name"]) == ("<oops>", "success", None, "openai.proxy")
    assert (e["output"], e["status"], e["error_message"]) == ("slow down", "error", "Upstream returned 429")
    assert (n["output"], n["status"], n["error_message"]) == (None, "error", "unreachable")
    assert (g["input"], g["output"], g["model"]) == ('{"z":1,"a":2}', '{"b":1}', "unknown")


def lines(spark, *texts, call="c"):
    return spark.createDataFrame([(call, i, t) for i, t in enumerate(texts)], "call_id string, seq int, line string")


def test_openai_stream(spark):
    df = lines(
        spark,
        'data: {"choices":[{"delta":{"content":"Hel"}}]}',
        "data: {broken",
        ": comment",
        '  data: {"choices":[{"delta":{"content":"lo"}}],"usage":{"prompt_tokens":1,"completion_tokens":2}}  ',
        'data: {"choices":[],"usage":{"prompt_tokens":3,"completion_tokens":4}}',
        "data: [DONE]",
        'data: {"choices":[{"delta":{"content":"!"}}]}',
    )
    row = c.assemble_sse_openai(c.sse_data_lines(df)).first()
    assert (row["output"], row["input_tokens"], row["output_tokens"]) == ("Hello", 3, 4)
    none = c.assemble_sse_openai(c.sse_data_lines(lines(spark, "event: x"))).first()
    assert (none["output"], none["input_tokens"], none["truncated"]) == ("", None, False)


def test_anthropic_stream(spark):
    events = [
        {"type": "message_start", "message": {"usage": {"input_tokens": 10}}},
        {"type": "content_block_start"},
        {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "Hello"}},
        {"type": "content_block_delta", "delta": {"type": "input_json_delta", "partial_json": "{"}},
        {"type": "content_block_delta", "delta": {"type": "text_delta", "text": " world"}},
        {"type": "message_delta", "usage": {"output_tokens": 5}},
        {"type": "message_stop"},
    ]
    df = lines(spark, *[f"data: {json.dumps(e)}" for e in events])
    row = c.assemble_sse_anthropic(c.sse_data_lines(df)).first()
    assert (row["output"], row["input_tokens"], row["output_tokens"]) == ("Hello world", 10, 5)


def test_byte_limit_spans_blocks(spark):
    # More lines than one block of the two-level running sum.
    n = 3 * c.SEQ_BLOCK // 2
    df = spark.range(n).select(
        F.lit("c").alias("call_id"), F.col("id").cast("int").alias("seq"), F.lit("data: é").alias("line")
    )
    limit = 9 * (c.SEQ_BLOCK + 10)  # each line has 8 bytes and a line break
    rows = c.sse_data_lines(df, limit)
    assert rows.filter("payload IS NOT NULL").count() == c.SEQ_BLOCK + 10 and rows.first()["truncated"]
    assert c.sse_data_lines(df, 9 * n).filter("truncated").count() == 0
    text = c.assemble_sse_generic(rows).first()["output"]
    assert text == "\n".join(["é"] * (c.SEQ_BLOCK + 10))
